"""Problem 1: page boilerplate mixed with main content.

Site template removal. A page is read as a tree of elements: sections under a heading, blocks (tables, quotes, fences, lines
with the items below them), lines and items, and the parts of a line (sentences, or what stands between the separators of a
menu, a path or an address). Every element is hashed with its numbers and its site's name masked, a block by the hash of all
its lines, a line also together with the kind of what hangs directly below it. The hashes are counted in Spark per site
(pages that hold it) and over sites (sites that hold it), and elements recurring across many pages of their site, or across
many sites, are deleted with what hangs below them:

* an image that recurs, and a table, quote or fence that recurs as a whole and stands among deleted elements: next to a kept
  one it is what the article quotes,
* a line that recurs, or whose parts do (all sentences of running text; ``PARTS`` of the parts of any other line, where the
  page's own title counts among them, as at the end of a path), or that begins with a recurring announcement ("Next: ..."),
* the short lines directly below a recurring line, where on most pages that hold this line short lines stand below it: the
  subtree recurs in its form, only its slots are filled anew on every page,
* a recurring heading all of whose section is deleted, or that is such a line itself.

Nothing is deleted for its form alone: form only tells which subtrees are alike. So an article's recurring heading stays with
its text, and lists, verses and captions stay unless they recur. The page's own title stays, once.

Scale. Elements of a page are reduced to distinct hashes before the shuffle and counted with partial sums, so that a hot site
costs as much as its distinct elements. The elements recurring on a site are a bounded list (each stands in ``SITE_SHARE`` of
its pages, so there are at most the mean number of elements of a page divided by this share) and come back as one row per
site, joined to its pages by site and a salt of one per ``SALTED`` pages. Elements recurring over sites are broadcast up to
``FEW`` of them and beyond that joined by hash. Texts are shuffled once, to find the newest row of a page.

Pages with null or empty text give no lines. Pages without a site count together as one site; in them any name may be the
site's. Redelivered rows of a page count once (the one loaded last). Lines end at LF only; a CR before it is not part of the
line. A line of any length is taken in whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from gleanery.functions.text import stripped
from gleanery.session import stored
from gleanery.sources.tables import latest

#: An element recurs on a site if so many of its pages hold it, and this share of them.
SITE_PAGES, SITE_SHARE = 3, 0.02
#: It recurs over sites if so many sites hold it, and this share of all sites.
SITES, SITES_SHARE = 3, 0.001
#: Share of the parts of a line that recur in a line of a template.
PARTS = 0.6
#: Share of a line's pages on which short lines stand below it, for these to be its slots.
SLOTS = 0.5
#: Pages of a site that share one salt.
SALTED = 20_000
#: Elements recurring over sites that are broadcast at most (8 bytes each).
FEW = 2_000_000

_NUMBER = re.compile(r"\d+")
_MARKER = re.compile(r"(?:[-*+•]|\d+[.)])\s+")
_HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*$")
_LINK = re.compile(r"!?\[([^\]]*)\]\([^)]*\)")
_IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)]*)\)$")
_PARTS = re.compile(r"\s*[·|/»›>,]\s*|\s?:\s+|\s{2,}|(?<=\))\s+(?=\[)")
_LEAD = re.compile(r"([^:.!?]{2,40}?)\s?:\s")
_SENTENCES = re.compile(r"(?<=[.!?…。！？])\s+")
_CLOSERS = "'\"”’»«)]*_」』 \t"
_NAMES = regex.compile(r"(?<!^)\b\p{Lu}[\p{L}\p{M}’'-]*+(?:\s\p{Lu}[\p{L}\p{M}’'-]*+)*|^\p{Lu}[\p{L}\p{M}’'-]*+(?:\s\p{Lu}[\p{L}\p{M}’'-]*+)+")
_NEXT_NAME = regex.compile(r" \p{Lu}[\p{L}\p{M}]*")
_LITERAL = re.compile(r"[^\W\d_]{3}")

# classes of lines
BLANK, BLOCK, QUOTED, HEAD, SHORT, LONG, MENU = range(7)
#: Low bit of an element that stands for a line with short lines directly below it; all others have it unset.
_BELOW = 1


def site_of(source: Column) -> Column:
    """Column of the site of a URL: host in lower case without port, ``www.`` and ``m.``; null if there is none."""
    host = F.regexp_extract(F.lower(F.trim(source)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.regexp_replace(host, r"^(?:www\d?\.|m\.|mobile\.|amp\.)+|\.$", "")
    return F.when(host != "", host)


def name_of(site: str | None) -> str:
    """The word of a site's name that its pages call it by: the first word of its host; empty if it is too short to tell."""
    word = re.split(r"[-.]", site)[0] if site else ""
    return word if len(word) > 2 else ""


def unbranded(text: str, name: str) -> str:
    """A text with § for the site's name, with one more capitalised word where there is one."""
    if not name:
        return text
    low = text.lower()
    at = low.find(name)
    if at < 0 or len(low) != len(text):
        return text
    out, begin = [], 0
    while at >= 0:
        end = at + len(name)
        if (not at or not text[at - 1].isalnum()) and not text[end : end + 1].isalnum():
            if m := _NEXT_NAME.match(text, end):
                end = m.end()
            out += [text[begin:at], "§"]
            begin = end
        at = low.find(name, end)
    return "".join(out) + text[begin:]


def hash_of(text: str) -> int:
    """Hash of an element as a signed number, numbers as 0 and in lower case."""
    h = xxh3_64_intdigest(_NUMBER.sub("0", text).casefold()) & ~_BELOW
    return h - (1 << 64) if h >> 63 else h


def _exact(text: str) -> int:
    h = xxh3_64_intdigest(text) & ~_BELOW
    return h - (1 << 64) if h >> 63 else h


def plain(line: str) -> str:
    """A line without list and heading marks and with links reduced to their text."""
    text = line.strip()
    if m := _MARKER.match(text):
        text = text[m.end() :]
    if m := _HEADING.match(text):
        text = m.group(2)
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    return " ".join(text.strip("*_ \t\r").split())


def is_long(text: str) -> bool:
    """Whether a text ends as running text does, rather than as a label."""
    end = text.rstrip(_CLOSERS)
    return end[-1:] in tuple(".!?…。！？") and len(end) > 3 and any(map(str.isalpha, end[-9:]))


def _forms(text: str, name: str, item: bool) -> list[int]:
    """Hashes of a line or heading as it is and, but for items of lists, with the names in it masked."""
    out = [hash_of(unbranded(text, name))]
    if not item:
        masked = _NAMES.sub("§", unbranded(text, name))
        if _LITERAL.search(masked) and (h := hash_of(masked)) != out[0]:
            out.append(h)
    return out


_MEMO: dict[tuple[str, str], tuple] = {}


def line_elements(line: str, name: str) -> tuple[int, list[list[int]], int]:
    """Class of a line that belongs to no block, the forms of its elements (the line itself first), and the hash of the
    announcement it begins with (0: none)."""
    if len(line) <= 200 and (hit := _MEMO.get((name, line))):
        return hit
    mark = line.strip()
    if m := _HEADING.match(mark):
        out = (HEAD, [_forms(plain(mark), name, False)], 0)
    elif m := _IMAGE.match(mark):
        out = (BLOCK, [[hash_of(f"!{unbranded(m.group(1), name)}\n{m.group(2)}")]], 0)
    else:
        item = bool(_MARKER.match(mark))
        text = plain(mark)
        if is_long(text):
            parts = [unbranded(p, name) for p in _SENTENCES.split(text)]
            forms = [[hash_of(p)] for p in parts]
            if not name:
                for f, p in zip(forms, parts):
                    if (h := hash_of(_NAMES.sub("§", p))) != f[0]:
                        f.append(h)
            out = (LONG, forms if len(forms) == 1 else [[], *forms], 0)
        else:
            lead = _LEAD.match(text)
            announced = hash_of(unbranded(lead.group(1), name) + ":") if lead else 0
            links = mark.count("](")
            bare = _LINK.sub(r"\1  ", _MARKER.sub("", mark, count=1)) if links else text
            parts = [p for p in (p.strip() for p in _PARTS.split(bare.strip("*_ \t"))) if p] if not item or links > 1 else []
            forms = [_forms(text, name, item)] + ([[hash_of(unbranded(p, name))] if name else _forms(p, name, False) for p in parts] if len(parts) > 1 else [])
            out = (SHORT, forms, announced)
    if len(line) <= 200:
        if len(_MEMO) > 100_000:
            _MEMO.clear()
        _MEMO[name, line] = out
    return out


def parse(md: str, site: str | None, title: str | None) -> tuple[bytes, list[int]]:
    """The page's elements: a code (see ``judge``) and the hashes it refers to, in order."""
    name = name_of(site)
    lines = md.split("\n")
    code, hashes = array("i"), []
    i, n = 0, len(lines)
    own = plain(title).casefold() if title else ""
    own_hash = hash_of(unbranded(plain(title), name)) if title else 0
    before: list[int] | None = None  # forms of the line directly above, if short lines may hang below it
    while i < n:
        mark = lines[i].strip()
        if not mark:
            code.append(BLANK)
            before = None
            i += 1
            continue
        c = mark[0]
        j = i
        if c in "`~" and mark.startswith(("```", "~~~")):
            j = i + 1
            while j < n and not lines[j].lstrip().startswith(mark[:3]):
                j += 1
            j = min(n, j + 1)
        elif c == "|" and mark.count("|") > 1 or c == ">":
            while j < n and lines[j].lstrip()[:1] == c:
                j += 1
        if j > i:
            code.extend((QUOTED, j - i))
            hashes.append(_exact("\n".join(x.strip() for x in lines[i:j])))
            before = None
            i = j
            continue
        kind, forms, announced = line_elements(lines[i], name)
        if kind == BLOCK:
            code.extend((BLOCK, 1))
            hashes.append(forms[0][0])
            before = None
        else:
            titled = kind != LONG and own != "" and plain(mark).casefold() == own
            if before and kind == SHORT and not titled:
                hashes.extend(h | _BELOW for h in before)
                code.append(MENU)  # the line above has short lines below it
                code.append(len(before))
            code.extend((kind, len(mark.split(" ", 1)[0]) if kind == HEAD else int(titled), len(forms), *map(len, forms)))
            for f in forms:
                hashes.extend(f)
            code.append(1 if announced else 0)
            if announced:
                hashes.append(announced)
            # the part that is the page's title, -1 for the line itself
            whole = kind != LONG and own != "" and (kind == HEAD or not _MARKER.match(mark)) and (titled or plain(mark).casefold() == own)
            code.append(-1 if whole else next((k for k, f in enumerate(forms) if k and f and f[0] == own_hash), 0) if own_hash and len(forms) > 1 else 0)
            before = forms[0] if kind in (HEAD, SHORT) and not titled else None
        i += 1
    return code.tobytes(), hashes


def judge(code: list[int], known: list[bool]) -> list[int]:
    """Numbers (from 1) of the lines that are deleted. code: as written by ``parse``; known: which hashes recur."""
    lines: list[list] = []  # class, level or whether it is the title, recurs, and of lines: is a slot, has slots
    blocks: list[tuple[int, int]] = []
    titles: list[int] = []
    at = spot = 0
    n = len(code)
    slots = False  # whether the line above recurs with slots below it
    while spot < n:
        kind = code[spot]
        if kind == BLANK:
            lines.append([BLANK, 0, False])
            slots = False
            spot += 1
        elif kind in (BLOCK, QUOTED):
            if kind == QUOTED and known[at]:
                blocks.append((len(lines), len(lines) + code[spot + 1]))
            lines += [[kind, 0, known[at]] for _ in range(code[spot + 1])]
            at += 1
            slots = False
            spot += 2
        elif kind == MENU:
            k = code[spot + 1]
            above = lines[-1]
            slots = slots and above[3] or above[2] and any(known[at : at + k])
            if slots and above[0] == HEAD:
                above[4] = True
            at += k
            spot += 2
        else:
            level, k = code[spot + 1], code[spot + 2]
            hits = []
            for m in code[spot + 3 : spot + 3 + k]:
                hits.append(any(known[at : at + m]))
                at += m
            spot += 3 + k
            led = False
            if code[spot]:
                led = known[at]
                at += 1
            own = code[spot + 1]
            spot += 2
            recurs = led or hits[0]
            if not recurs and k > 1:
                some = sum(hits[1:])
                recurs = some > 0 and (some + (own > 0 and not hits[own])) >= (k - 1) * (1 if kind == LONG else PARTS)
            slot = slots and kind == SHORT and not level
            if own < 0:
                titles.append(len(lines))
            lines.append([kind, level, recurs or slot, slot, False])
            slots = slot
    if titles:
        lines[next((i for i in titles if lines[i][0] == HEAD), titles[0])][2] = False
    # a recurring heading goes with its section, or with its slots
    last = len(lines)
    for i in range(len(lines) - 1, -1, -1):
        line = lines[i]
        if line[0] == HEAD:
            if line[2] and not line[4]:
                below = [x[2] and x[0] != QUOTED for x in lines[i + 1 : last] if x[0] != BLANK]
                line[2] = bool(below) and all(below)
            last = i
    # what the article quotes
    for a, b in blocks:
        above = next((x[2] for x in reversed(lines[:a]) if x[0] != BLANK), True)
        below = next((x[2] for x in lines[b:] if x[0] != BLANK), True)
        if not (above and below):
            for x in lines[a:b]:
                x[2] = False
    return [i for i, x in enumerate(lines, 1) if x[2]]


def _recurring(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(s, flags)``: the elements recurring on each site; ``(e)``: those recurring over sites. s: number of a site."""
    held = pages.select("s", F.explode(F.array_distinct("e")).alias("x"))
    below = F.col("x").bitwiseAND(_BELOW) == 1
    e = F.when(below, F.col("x") - _BELOW).otherwise(F.col("x")).alias("e")
    per_site = held.groupBy("s", e).agg(F.count_if(~below).alias("n"), F.count_if(below).alias("m"))
    sizes = pages.groupBy("s").agg(F.count("*").alias("pages"))
    least = F.greatest(F.lit(SITE_PAGES), SITE_SHARE * F.col("pages"))
    common = per_site.filter(F.col("n") >= SITE_PAGES).join(sizes, "s").filter(F.col("n") >= least)
    with_slots = (F.col("m") >= least) & (F.col("m") >= SLOTS * F.col("n"))
    flags = common.groupBy("s").agg(F.flatten(F.collect_list(F.when(with_slots, F.array("e", F.col("e") + _BELOW)).otherwise(F.array("e")))).alias("flags"))
    over = per_site.groupBy("e").agg(F.count_if(F.col("n") > 0).alias("n"), F.count_if((F.col("m") > 0) & (F.col("m") >= SLOTS * F.col("n"))).alias("m")).filter(F.col("n") >= SITES)
    sites = F.broadcast(sizes.agg(F.count("*").alias("sites")))  # one row
    least = F.greatest(F.lit(SITES), SITES_SHARE * F.col("sites"))
    over = over.join(sites).filter(F.col("n") >= least)
    with_slots = (F.col("m") >= least) & (F.col("m") >= SLOTS * F.col("n"))
    return flags, over.select(F.explode(F.when(with_slots, F.array("e", F.col("e") + _BELOW)).otherwise(F.array("e"))).alias("e"))


def page_lines(clippings: DataFrame, text: bool = False) -> DataFrame:
    """``(clip_id, removed)`` and, if asked for, ``md``: the numbers (from 1) of the lines that are neither blank nor part of
    the article."""
    rows = latest(clippings.select("clip_id", "title", "source", "md", "loaded_at"), "clip_id").filter(F.col("md").isNotNull() & (F.col("md") != ""))
    rows = rows.select("clip_id", site_of(F.col("source")).alias("site"), "title", "md")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sites, titles, texts = (batch.column(k).to_pylist() for k in (1, 2, 3))
            codes, flat, ends = [], array("q"), array("i", [0])
            for site, title, md in zip(sites, titles, texts):
                code, hashes = parse(md, site, title)
                codes.append(code)
                flat.extend(hashes)
                ends.append(len(flat))
            e = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(flat, np.int64)))
            columns = [batch.column(0), batch.column(1), pa.array(codes, pa.binary()), e] + ([batch.column(3)] if text else [])
            yield pa.RecordBatch.from_arrays(columns, names=["clip_id", "site", "code", "e", "md"][: len(columns)])

    extra = ", md string" if text else ""
    parsed = rows.mapInArrow(read, "clip_id bigint, site string, code binary, e array<bigint>" + extra)
    pages = stored(parsed.withColumn("s", F.xxhash64("site")).drop("site"), "parsed")
    flags, over = _recurring(pages)
    over = stored(over, "over")
    salts = pages.groupBy("s").agg(F.ceil(F.count("*") / SALTED).cast("int").alias("salts"))
    flags = flags.join(salts, "s").select("s", "flags", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = pages.join(salts, "s").withColumn("salt", F.pmod(F.xxhash64("clip_id"), F.col("salts")).cast("int"))
    met = salted.join(flags, ["s", "salt"], "left").withColumn("marks", F.array_intersect("e", F.coalesce("flags", F.array().cast("array<bigint>"))))
    few = over.count() <= FEW
    if not few:
        each = pages.select("clip_id", F.explode(F.array_distinct("e")).alias("e")).join(over, "e", "left_semi")
        met = met.join(each.groupBy("clip_id").agg(F.collect_list("e").alias("wide")), "clip_id", "left")
        met = met.withColumn("marks", F.concat("marks", F.coalesce("wide", F.array().cast("array<bigint>"))))
    shared = clippings.sparkSession.sparkContext.broadcast(np.sort(over.toPandas()["e"].to_numpy(np.int64)) if few else np.empty(0, np.int64))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            e = batch.column(2)
            flat, ends = e.values.to_numpy(), e.offsets.to_numpy()
            place = np.searchsorted(everywhere, flat)
            wide = everywhere[np.minimum(place, max(0, len(everywhere) - 1))] == flat if len(everywhere) else np.zeros(len(flat), bool)
            removed = []
            for code, marks, a, b in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), ends, ends[1:]):
                here = set(marks)
                known = [w or x in here for w, x in zip(wide[a:b].tolist(), flat[a:b].tolist())]
                removed.append(judge(array("i", code).tolist(), known))
            columns = [batch.column(0), pa.array(removed, pa.list_(pa.int32()))] + ([batch.column(4)] if text else [])
            yield pa.RecordBatch.from_arrays(columns, names=["clip_id", "removed", "md"][: len(columns)])

    columns = ["clip_id", "code", "e", "marks"] + (["md"] if text else [])
    return met.select(*columns).mapInArrow(decide, "clip_id bigint, removed array<int>" + extra)


def found(clippings: DataFrame) -> DataFrame:
    """``(clip_id, line_no)`` of every line that is not blank and not part of the article."""
    return page_lines(clippings).select("clip_id", F.explode("removed").alias("line_no"))


def articles(clippings: DataFrame) -> DataFrame:
    """``(clip_id, article, n_lines, n_removed)``: the main body of each page, other lines deleted, blank lines in a row merged."""
    lines = F.split("md", "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.col("removed"), i + 1))
    body = stripped(F.regexp_replace(F.array_join(kept, "\n"), r"\n(?:[ \t\r]*\n){2,}", "\n\n"))
    return page_lines(clippings, text=True).select("clip_id", body.alias("article"), F.size(lines).alias("n_lines"), F.size("removed").alias("n_removed"))
