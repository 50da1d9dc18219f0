"""Checks of content: quotations against their evidence, and wording by lexicons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T

#: Wording that is flagged, by kind, and the kinds that apply to a folder.
LEXICON = {
    "editorializing": [
        "clearly", "obviously", "notably", "importantly", "interestingly", "essentially", "fundamentally", "of course", "arguably", "undoubtedly",
        "sadly", "fortunately", "unfortunately", "it should be noted",
    ],
    "weasel": ["some say", "some people say", "it is believed", "widely regarded", "experts declare", "research has shown", "it is often said", "critics argue", "many people"],
    "said-verbs": ["revealed", "admitted", "confessed", "insisted"],
    "puffery": ["legendary", "world-class", "groundbreaking", "revolutionary", "iconic", "visionary", "cutting-edge"],
    "doubt": ["so-called", "supposedly", "purported", "purportedly", "allegedly"],
}
#: Kinds checked per folder.
APPLIES = {"wiki/entities/": ["editorializing", "weasel", "said-verbs", "puffery", "doubt"], "wiki/concepts/": ["editorializing", "weasel"], "wiki/sources/": ["editorializing", "weasel"]}
#: Punctuation at the ends of a fragment, which is quoting convention.
EDGES = r"^[.,;:!?\s]+|[.,;:!?\s]+$"
#: Word borders are those of ASCII words.
CONNECTIVES = r"(?i)(^|[^A-Za-z0-9_])(however|but|despite|yet)([^A-Za-z0-9_]|$)"


def word_pattern(word: str) -> str:
    """Pattern of a word or phrase, blanks and hyphens alike, not inside a longer word."""
    spelt = "[- ]".join(p for p in word.replace("-", " ").split(" "))
    return rf"(?i)(^|[^A-Za-z0-9_-]){spelt}([^A-Za-z0-9_-]|$)"


def style(df: DataFrame, key: str, path: str, text: str, lexicon: dict[str, list[str]] | None = None, applies: dict[str, list[str]] | None = None) -> DataFrame:
    """``key, category, word``: flagged wording outside quotations. One pattern per category prefilters the rows; only what it
    hits is held against the single words."""
    lexicon, applies = lexicon or LEXICON, applies or APPLIES
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), '["“][^"“”]*["”]', '""')
    rows = df.select(key, F.col(path).alias("p"), body.alias("b"))
    checks = []
    for category, words in lexicon.items():
        folders = [f for f, kinds in applies.items() if category in kinds]
        here = F.lit(False)
        for f in folders:
            here = here | F.col("p").startswith(f)
        one = [F.when(F.col("b").rlike(word_pattern(w)), F.struct(F.lit(category).alias("category"), F.lit(w).alias("word"))) for w in words]
        some = F.col("b").rlike("(?i)" + "|".join(w.replace("-", " ").replace(" ", "[- ]") for w in words))
        checks.append(F.when(here & some, F.filter(F.array(*one), lambda x: x.isNotNull())).otherwise(F.array().cast("array<struct<category:string,word:string>>")))
    return rows.select(key, F.explode(F.flatten(F.array(*checks))).alias("x")).select(key, "x.category", "x.word").distinct()


def connectives(df: DataFrame, key: str, path: str, text: str, folder: str = "wiki/syntheses/") -> DataFrame:
    """``key, sentence``: sentences with a contrast and no citation, their first 70 characters."""
    rows = df.filter(F.col(path).startswith(folder)).select(key, F.explode(T.sentences(F.col(text))).alias("s"))
    return rows.filter(F.col("s").rlike(CONNECTIVES) & ~F.col("s").contains("[[")).select(key, F.left(T.stripped(F.col("s")), F.lit(70)).alias("sentence"))


def quotes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, quote_no, quote, fragment_no, fragment``: fragments to be found, in matching form without punctuation at the ends."""
    q = df.select(key, F.posexplode(T.quoted_spans(F.col(text))).alias("quote_no", "quote"))
    return q.select(key, "quote_no", "quote", F.posexplode(T.fragments(F.col("quote"))).alias("fragment_no", "f")).select(key, "quote_no", "quote", "fragment_no", F.regexp_replace(T.matching_form(F.col("f")), EDGES, "").alias("fragment"))


def unsupported_quotes(quoted: DataFrame, evidence: DataFrame, bodies: DataFrame, key: str) -> DataFrame:
    """Quotations of which a fragment stands in none of the page's evidence: ``key, quote_no, quote, missing``.

    evidence: ``key, source``; bodies: ``source, body`` in matching form. Pages without evidence have all fragments missing.
    Each fragment meets its own page's evidence only."""
    tried = quoted.join(evidence.select(key, "source").distinct(), key, "left").join(bodies.select("source", "body"), "source", "left")
    found = tried.groupBy(key, "quote_no", "quote", "fragment_no").agg(F.coalesce(F.bool_or(F.contains("body", "fragment")), F.lit(False)).alias("ok"))
    return found.groupBy(key, "quote_no", "quote").agg(F.count_if(~F.col("ok")).alias("missing")).filter("missing > 0")


def resourced_quotes(missing: DataFrame, bodies: DataFrame, key: str, anchor: int = 40) -> DataFrame:
    """``key, quote_no, source``: the first text that contains all fragments of a quotation, for quotations with a fragment of at
    least ``anchor`` characters. missing: fragments as of ``quotes``.

    Candidates are found by the hash of an equal window of ``anchor`` characters anywhere in the texts, not by holding every
    fragment against every text; containment decides."""
    long = missing.filter(F.length("fragment") >= anchor).groupBy(key, "quote_no").agg(F.min("fragment_no").alias("fragment_no"))
    probe = missing.join(long, [key, "quote_no", "fragment_no"]).select(key, "quote_no", F.xxhash64(F.left("fragment", F.lit(anchor))).alias("window"))
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.length("body") - anchor + 1, F.lit(1))), lambda i: F.xxhash64(F.substr(F.col("body"), i, F.lit(anchor))))
    spots = bodies.select("source", F.explode(F.array_distinct(starts)).alias("window"))
    near = probe.join(spots, "window").select(key, "quote_no", "source").distinct().join(bodies, "source")
    whole = missing.groupBy(key, "quote_no").agg(F.collect_list("fragment").alias("fragments"))  # fragments of one quotation
    ok = near.join(whole, [key, "quote_no"]).filter(F.forall("fragments", lambda f: F.contains(F.col("body"), f)))
    return ok.groupBy(key, "quote_no").agg(F.min("source").alias("source"))
