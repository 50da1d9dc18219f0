"""Plans of repairs: recorded hashes, citations, binaries with a text twin, titles; and rewriting of frontmatter."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T


def hash_backfill(cites: DataFrame, clips: DataFrame, recorded: DataFrame) -> DataFrame:
    """``page, target, class, source_hash``: which hash each citation of a source page should record: exact path or name, else
    the name without its hash suffix; ``add``, ``have``, ``unresolved``, ``ambiguous`` or ``nohash``.

    cites: ``page, target`` (a clip name); clips: ``path, name, source_hash``; recorded: ``page, source_hash``."""
    exact = clips.select(F.col("name").alias("key"), F.lit(0).alias("rank"), "path", "source_hash")
    bare = clips.select(T.bare_title(F.col("name")).alias("key"), F.lit(1).alias("rank"), "path", "source_hash")
    both = exact.unionByName(bare).groupBy("key", "rank").agg(F.countDistinct("path").alias("n"), F.min(F.struct("path", "source_hash")).alias("c"))
    best = both.groupBy("key").agg(F.min(F.struct("rank", "n", F.col("c.source_hash").alias("source_hash"))).alias("b"))
    rows = cites.distinct().join(best, F.col("target") == F.col("key"), "left")
    have = recorded.select("page", "source_hash", F.lit(True).alias("have")).distinct()
    rows = rows.select("page", "target", F.col("b.n").alias("n"), F.col("b.source_hash").alias("source_hash")).join(have, ["page", "source_hash"], "left")
    kind = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") > 1, "ambiguous").when(F.col("source_hash").isNull(), "nohash").when(F.col("have"), "have").otherwise("add")
    return rows.select("page", "target", kind.alias("class"), F.when(kind.isin("add", "have"), F.col("source_hash")).alias("source_hash"))


def citation_repair(broken: DataFrame, candidates: DataFrame) -> DataFrame:
    """``page, target, path``: broken citations put right. A page's candidates (clips whose hash it records but which it does not
    cite) are used up in order of target: one whose name is the target's unambiguously, else, if one of each is left, the rest.

    broken: ``page, target``; candidates: ``page, path, name``. A page's lists are short, so each page is one group."""

    def one(targets: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        free = dict(sorted(zip(found["path"], found["name"])))
        form = lambda x: re.sub(r"[^a-z0-9]+", " ", re.sub(r"-[0-9a-f]{7}(-\d+)?$", "", str(x).lower())).strip()
        out, open_ = [], []
        for page, target in sorted(set(zip(targets["page"], targets["target"]))):
            hits = [p for p, n in free.items() if form(n) == form(target)]
            if len(hits) == 1:
                out.append((page, target, hits[0]))
                free.pop(hits[0])
            else:
                open_.append((page, target))
        if len(open_) == 1 and len(free) == 1:
            out.append((*open_[0], next(iter(free))))
        return pd.DataFrame(out, columns=["page", "target", "path"])

    return broken.groupBy("page").cogroup(candidates.groupBy("page")).applyInPandas(one, "page string, target string, path string")


def title_match(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """``title, match``: the known title in the same normal form, if there is one only; else the only one of which one contains
    the other. Titles of fewer than two words match only exactly.

    A title contains another as whole words only if it holds that one's first two words side by side; so titles meet by word
    pairs, not each with each. wanted and known: ``title``."""
    w = wanted.select("title", T.normal_name(F.col("title")).alias("a")).filter("a <> ''").distinct()
    k = known.select(F.col("title").alias("match"), T.normal_name(F.col("title")).alias("b")).filter("b <> ''").distinct()
    exact = w.join(k, F.col("a") == F.col("b")).groupBy("title").agg(F.count("*").alias("n"), F.min("match").alias("match"))
    rest = w.join(exact.select("title"), "title", "left_anti")

    def pairs(c: Column) -> Column:
        words = F.split(c, " ")
        n = F.size(words)
        return F.when(n > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(words, i, 2), " "))))

    first = lambda c: F.array_join(F.slice(F.split(c, " "), 1, 2), " ")
    two = lambda c: F.size(F.split(c, " ")) > 1
    longer = rest.select("title", "a", F.explode(pairs(F.col("a"))).alias("p")).join(k.filter(two(F.col("b"))).select("match", "b", first(F.col("b")).alias("p")), "p")
    shorter = rest.filter(two(F.col("a"))).select("title", "a", first(F.col("a")).alias("p")).join(k.select("match", "b", F.explode(pairs(F.col("b"))).alias("p")), "p")
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    near = longer.unionByName(shorter).filter(F.contains(pad(F.col("a")), pad(F.col("b"))) | F.contains(pad(F.col("b")), pad(F.col("a")))).select("title", "match").distinct()
    single = near.groupBy("title").agg(F.count("*").alias("n"), F.min("match").alias("match"))
    return exact.unionByName(single).filter("n = 1").select("title", "match")


def binary_plan(binaries: DataFrame, clips: DataFrame, citers: DataFrame) -> DataFrame:
    """``path, action, twin, n_citers``: a binary with a text twin of its title is only moved; otherwise its text is extracted
    where that is possible, else it is blocked. binaries: ``path``; clips: ``path, title``; citers: ``path, page``."""
    form = lambda c: F.lower(T.bare_title(T.title_of_file(c)))
    b = binaries.select("path", form(F.col("path")).alias("k"))
    twins = clips.select(F.lower(F.trim("title")).alias("k"), F.col("path").alias("twin")).filter("k <> ''").groupBy("k").agg(F.min("twin").alias("twin"))
    n = citers.groupBy("path").agg(F.countDistinct("page").alias("n_citers"))
    action = F.when(F.col("twin").isNotNull(), "move").when(F.col("path").rlike(r"(?i)\.(pdf|docx|xlsx|html?)$"), "extract").otherwise("blocked")
    return b.join(twins, "k", "left").join(n, "path", "left").select("path", action.alias("action"), "twin", F.coalesce("n_citers", F.lit(0)).alias("n_citers"))


def with_source_hash(text: Column, value: Column) -> Column:
    """Text whose frontmatter has a ``source-hash``, added as its last line if it had none; unchanged without frontmatter."""
    fm = T.frontmatter(text)
    head = F.concat(F.lit("---\n"), fm, F.lit("\nsource-hash: "), value, F.lit("\n---"))
    rest = F.substring(text, F.length(F.regexp_extract(text, T.FRONTMATTER, 0)) + 1, F.length(text))
    return F.when((fm == "") | fm.rlike(r"(?m)^source-hash:") | value.isNull(), text).otherwise(F.concat(head, rest))


def swapped(text: Column, old: Column, new: Column) -> Column:
    """All occurrences of one hash replaced by another."""
    return F.replace(text, old, new)


def repointed(text: Column, old: Column, new: Column) -> Column:
    """A citation replaced in the frontmatter only."""
    head = F.regexp_extract(text, T.FRONTMATTER, 0)
    return F.concat(F.replace(head, old, new), F.substring(text, F.length(head) + 1, F.length(text)))


def merge_frontmatter_list(df: DataFrame, key: str, text: str, add: str, field: str) -> DataFrame:
    """``key, text``: entries of the array column ``add`` merged into a list of the frontmatter, in flow or block form; entries
    that are there (by link name) stay as they are. The list is created after ``sources`` or at the end."""

    def name(entry: str) -> str:
        m = re.search(r"\[\[([^\]|#]+)", entry)
        return re.sub(r"\.md$", "", (m.group(1) if m else entry).strip().strip("\"'").split("/")[-1]).lower()

    def merged(t: str, entries: list[str]) -> str:
        m = re.match(r"---\r?\n(.*?)\r?\n---", t, re.S)
        if not m or not entries:
            return t
        fm = m.group(1)
        flow = re.search(rf"^{field}:[ \t]*\[(.*)\][ \t]*$", fm, re.M)
        block = re.search(rf"^{field}:[ \t]*((?:\n[ \t]+-.*)+)", fm, re.M)
        there = re.findall(r'"[^"]*"|[^,\s][^,]*', flow.group(1)) if flow else re.findall(r"-\s*(.*)", block.group(1)) if block else []
        have = {name(x) for x in there}
        fresh = [e for e in dict.fromkeys(entries) if name(e) not in have]
        if not fresh:
            return t
        if block:
            new = fm[: block.end()] + "".join(f'\n  - "{e}"' for e in fresh) + fm[block.end() :]
        else:
            line = f"{field}: [" + ", ".join([*[x.strip() for x in there], *[f'"{e}"' for e in fresh]]) + "]"
            after = re.search(r"^sources:.*(?:\n[ \t]+-.*)*", fm, re.M)
            new = fm[: flow.start()] + line + fm[flow.end() :] if flow else (fm[: after.end()] + "\n" + line + fm[after.end() :] if after else fm + "\n" + line)
        return t[: m.start(1)] + new + t[m.end(1) :]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "t": [merged(t, list(a) if a is not None else []) for t, a in zip(b["t"], b["a"])]})

    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(add).alias("a")).filter("t is not null")
    return rows.mapInPandas(run, f"k {kind}, t string").select(F.col("k").alias(key), F.col("t").alias("text"))


def dewrapped(target: Column) -> Column:
    """What a link target broken over lines may have been: joined by a blank, and without one where a hyphen ends the line."""
    spaced = T.collapsed(target)
    closed = T.collapsed(F.regexp_replace(target, r"-[ \t]*\r?\n[ \t]*", "-"))
    return F.array_distinct(F.array(closed, spaced, T.collapsed(F.regexp_replace(target, r"-[ \t]*\r?\n[ \t]*", ""))))


def resolve_dewrap(targets: DataFrame, names: DataFrame) -> DataFrame:
    """``target, chosen``: the candidate that is a known name, if they name one only; of its spellings the first. names: ``name``."""
    c = targets.select("target").distinct().select("target", F.posexplode(dewrapped(F.col("target"))).alias("i", "candidate"))
    known = names.select(T.normal_name(F.col("name")).alias("n")).filter("n <> ''").distinct()
    hit = c.withColumn("n", T.normal_name(F.col("candidate"))).join(known, "n").groupBy("target").agg(F.countDistinct("n").alias("k"), F.min_by("candidate", "i").alias("chosen"))
    return hit.filter("k = 1").select("target", "chosen")


def roadmap_items(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, item_no, title, slug, body``: top-level list items of a text, each with what is indented below it."""
    parts = F.split(F.concat(F.lit("\n"), F.coalesce(F.col(text), F.lit(""))), r"\n(?=[-*] )")
    rows = df.select(key, F.posexplode(parts).alias("item_no", "item")).filter("item_no > 0")
    first = F.regexp_extract("item", r"^[-*] ([^\n]*)", 1)
    title = T.stripped(F.regexp_replace(F.regexp_extract(first, r"^(?:\[.\] )?\**(.*?)\**(?:[:.—–].*)?$", 1), r"[*_`]", ""))
    rows = rows.select(key, "item_no", title.alias("title"), T.stripped(F.regexp_replace("item", r"^[-*] [^\n]*\n?", "")).alias("body"))
    from pyspark.sql import Window

    slug = T.kebab(F.col("title"))
    again = F.row_number().over(Window.partitionBy(key, slug).orderBy("item_no"))
    return rows.withColumn("n", again).select(key, "item_no", "title", F.when(F.col("n") == 1, slug).otherwise(F.concat(slug, F.lit("-"), F.col("n"))).alias("slug"), "body")


def distinct_slugs(df: DataFrame, key: str, title: str, suffix: str, ranges: int = 64) -> DataFrame:
    """``key, slug``: file names without clashes: the second of one slug gets the first 7 characters of ``suffix``, further
    ones a number as well.

    Rows of one slug (untitled ones, say) may be many: they are numbered within ranges of the key, found by its quantiles, and
    the counts of the ranges before are added."""
    from pyspark.sql import Window

    slug = T.slug(F.col(title))
    cuts = df.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 1000)).head()[0] or []
    part = F.aggregate(F.array(*[F.lit(c) for c in sorted(set(cuts))]), F.lit(0), lambda n, c: n + (F.col(key) > c).cast("int")) if cuts else F.lit(0)
    short = F.left(F.coalesce(F.col(suffix), F.lit("")), F.lit(7))
    name = F.when(F.col("n") == 1, F.col("s")).when(F.col("n") == 2, F.concat("s", F.lit("-"), short)).otherwise(F.concat("s", F.lit("-"), short, F.lit("-"), F.col("n") - 1))
    rows = df.withColumn("s", slug).withColumn("part", part)
    sizes = rows.groupBy("s", "part").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("s", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("s", "part").orderBy(key))
    return rows.withColumn("i", within).join(offsets, ["s", "part"]).withColumn("n", F.col("i") + F.col("offset")).select(key, name.alias("slug"))
