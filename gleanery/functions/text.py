"""Column functions over document text: frontmatter, links, names, slugs, canonical forms. All run inside Spark's code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _some(c: Column) -> Column:
    """Null for an empty string, as a pattern without a match gives one."""
    return F.nullif(c, F.lit(""))


def stripped(c: Column) -> Column:
    """Without outer white space of any kind (``trim`` takes blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    return stripped(F.regexp_replace(c, r"\s+", " "))


FRONTMATTER = r"(?s)^---\r?\n(.*?)\r?\n---"


def frontmatter(text: Column) -> Column:
    """The block between the leading ``---`` lines; an empty string if there is none."""
    return F.regexp_extract(text, FRONTMATTER, 1)


def body(text: Column) -> Column:
    """What follows the frontmatter; all of the text if there is none."""
    return F.regexp_replace(text, FRONTMATTER + r"(\r?\n)?", "")


def field(fm: Column, name: str) -> Column:
    """A scalar field of frontmatter, without quotes; null if absent or empty."""
    raw = F.regexp_extract(fm, rf"(?m)^{name}:[ \t]*(.*?)[ \t\r]*$", 1)
    return _some(F.regexp_replace(raw, r"""^["']|["']$""", ""))


def declares_no_sources(fm: Column) -> Column:
    """Whether the frontmatter says ``sources: []``, as against not saying anything."""
    return fm.rlike(r"(?m)^sources:[ \t]*\[[ \t]*\][ \t\r]*$")


def wikilinks(text: Column) -> Column:
    """Targets of all wikilinks in order, repeats kept, without alias and anchor, blanks trimmed, none empty."""
    targets = F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)"), F.lit(1)), stripped)
    return F.filter(targets, lambda t: t != "")


def hash_list(fm: Column) -> Column:
    """Content hashes of ``source-hashes`` (flow or block list), lower case; null if there are none."""
    block = F.regexp_extract(fm, r"(?m)^source-hashes:((?:.*)(?:\r?\n[ \t]+-.*)*)", 1)
    found = F.transform(F.regexp_extract_all(block, F.lit(r"\b([0-9a-fA-F]{6,64})\b"), F.lit(1)), F.lower)
    return F.when(F.size(found) > 0, found)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def callouts(text: Column) -> Column:
    """Dated callouts in bold: an update, a milestone or a change of status, with its date in parentheses."""
    return F.regexp_count(text, F.lit(r"(?i)\*\*[^*\n]{0,80}(?:update|milestone|status updated)[^*\n]{0,80}\(\d{4}-\d{2}-\d{2}"))


def normal_name(name: Column) -> Column:
    """A name for matching: lower case, every run of other than ASCII letters and digits one blank."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", " "))


def file_name(path: Column) -> Column:
    """Last part of a path, ``.md`` dropped."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?i)\.md$", "")


def title_of_file(path: Column) -> Column:
    """Title from a file path in either notation: base name without extension, underscores as blanks."""
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.trim(F.translate(F.regexp_replace(base, r"\.[A-Za-z0-9]{1,5}$", ""), "_", " "))


def bare_title(name: Column) -> Column:
    """A clip's name without its hash suffix."""
    return F.regexp_replace(name, r"-[0-9a-f]{7}(-\d+)?$", "")


def slug(title: Column, cap: int = 120) -> Column:
    """File name for a title: characters not allowed in names as hyphens, cut, hyphens at the ends dropped, never empty."""
    s = F.regexp_replace(title, r'[\\/:*?"<>|#^\[\]]+', "-")
    s = F.left(F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"-{2,}", "-"), F.lit(cap))
    return F.coalesce(_some(F.regexp_replace(s, r"^[-. ]+|[-. ]+$", "")), F.lit("untitled"))


def log_slug(title: Column, cap: int = 60, default: str = "entry") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(_some(F.regexp_replace(F.left(s, F.lit(cap)), r"-+$", "")), F.lit(default))


def kebab(title: Column) -> Column:
    s = F.regexp_replace(F.lower(title), r"['’]", "")
    return F.coalesce(_some(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")), F.lit("untitled"))


def topic_label(topic: Column) -> Column:
    """A topic as shown: white space collapsed; null if blank."""
    return _some(collapsed(topic))


def topic_key(topic: Column) -> Column:
    return F.lower(topic_label(topic))


def canonical_body(text: Column) -> Column:
    """The body that is hashed: LF line ends, no trailing blanks, at most one empty line in a row, outer white space dropped."""
    t = F.regexp_replace(F.regexp_replace(text, r"\r\n", "\n"), r"(?m)[ \t]+$", "")
    return stripped(F.regexp_replace(t, r"\n{3,}", "\n\n"))


#: Ligatures and what they stand for.
LIGATURES = [("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff")]


def matching_form(text: Column) -> Column:
    """Text for finding quotations: ligatures spelt out, line-end hyphens joined, quotes, emphasis and dashes dropped, lower case."""
    t = text
    for ligature, letters in LIGATURES:
        t = F.replace(t, F.lit(ligature), F.lit(letters))
    t = F.regexp_replace(t, r"-[ \t]*\r?\n[ \t]*", "")
    t = F.regexp_replace(t, "['‘’\"“”*_`—–-]", "")
    return stripped(F.lower(F.regexp_replace(F.replace(t, F.lit("…"), F.lit("...")), r"\s+", " ")))


def quoted_spans(text: Column, least: int = 5) -> Column:
    """Quotations of at least ``least`` words: curly pairs first, then, with these removed, straight ones."""
    curly = r"“([^“”]+?)”"
    straight = F.regexp_extract_all(F.regexp_replace(text, curly, " "), F.lit('"([^"]*?)"'), F.lit(1))
    both = F.concat(F.regexp_extract_all(text, F.lit(curly), F.lit(1)), straight)
    return F.filter(both, lambda q: F.regexp_count(q, F.lit(r"\S+")) >= least)


def fragments(quote: Column, least: int = 3) -> Column:
    """Parts of a quotation between elisions and bracketed insertions, of at least ``least`` words."""
    return F.filter(F.transform(F.split(quote, r"\.\.\.|…|\[[^\]]*\]"), stripped), lambda f: F.regexp_count(f, F.lit(r"\S+")) >= least)


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def quoted_yaml(value: Column) -> Column:
    """A value as a quoted scalar of frontmatter."""
    return F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def clip_frontmatter(fields: dict[str, Column], lists: dict[str, Column] | None = None) -> Column:
    """A frontmatter block of the fields that aren't null, in the order given; values must be ready to write."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in (fields | (lists or {})).items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def fenced(text: Column, block: Column, begin: str, end: str) -> Column:
    """``text`` with what stands between the marks replaced by ``block``, or with both appended if the marks are missing."""
    a, b = F.instr(text, begin), F.instr(text, end)
    inside = F.concat(F.lit(begin + "\n"), block, F.lit("\n" + end))
    there = (a > 0) & (b > a)
    replaced = F.concat(F.substring(text, F.lit(1), a - 1), inside, F.substr(text, b + len(end)))
    return F.when(there, replaced).otherwise(F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n\n"), inside, F.lit("\n")))
