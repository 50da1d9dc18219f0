"""Upkeep: grades, ids, declines, running lines, frontmatter."""

import re

from pyspark.sql import functions as F

from gleanery.operators import upkeep as U


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).collect()[0]["x"]


def test_grades(spark):
    flags = {k: F.col(k) for k in U.POINTS}
    grade = lambda **v: one(spark, U.credibility(flags), **{k: v.get(k, False) for k in U.POINTS})
    assert grade(primary=True, recent=True, corroborated=True) == "high" and grade(primary=True) == "medium"
    assert grade(recent=True, promotional=True) == "low" and grade(promotional=True) == "reject"
    assert one(spark, U.is_flagged(F.col("f")), f="degraded") and not one(spark, U.is_flagged(F.col("f")), f="ok")
    assert one(spark, U.thin_outcome(F.col("a")), a=True) == "thin" and one(spark, U.thin_outcome(F.col("a")), a=False) == "ocr-unavailable"


def test_free_ids_take_the_first_gap(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = {tuple(r) for r in U.free_ids(ids("a", "b", "c", "d", "e"), ids("a", "a-2", "a-4", "b-2", "c", "c-x", "d", "d-2", "d-3", "d-03")).collect()}
    assert got == {("a", "a-3"), ("b", "b"), ("c", "c-2"), ("d", "d-4"), ("e", "e")}


def test_declines_are_replayed_once_in_the_first_spelling(spark):
    rows = spark.createDataFrame([(2, "HTTP://X"), (1, "http://x"), (1, "http://y"), (3, None)], "at int, url string")
    assert {r["url"] for r in U.replayed_declines(rows, spark.createDataFrame([("HTTP://Y",), (None,)], "url string")).collect()} == {"http://x"}


def plain(text):
    pages = text.split("\f")
    if len(pages) < 4:
        return "\n".join(pages)
    mask = lambda s: re.sub(r"\d+", "#", s.strip())
    rows = [p.split("\n") for p in pages]
    at = [[i for i, x in enumerate(r) if x.strip()] for r in rows]
    seen = [mask(r[i]) for r, a in zip(rows, at) if a for i in (a[0], a[-1])]
    running = {x for x in seen if seen.count(x) >= max(3, len(pages) // 2)}
    for r, a in zip(rows, at):
        for i in {a[0], a[-1]} if a else ():
            if mask(r[i]) in running:
                r[i] = ""
    return "\n".join("\n".join(r) for r in rows)


def test_running_lines_are_emptied(spark):
    texts = ["\f".join(f"Title\nbody {i} x\n\nPage {i}" for i in range(6)), "one\ftwo", "", "\f\f\f\f", "\f".join(f"Only {i}" for i in range(5)), "\f".join(["A\nb", "A\nc", "A\nd", "x\ny"])]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", U.without_running_lines(F.col("t")).alias("x")).collect()
    assert {r["i"]: r["x"] for r in rows} == {i: plain(t) for i, t in enumerate(texts)}


def test_frontmatter_is_mended(spark):
    bad = "---\ntitle: t\nsources:\nsource-hashes: [a]\n  - \"[[x]]\"\n  - \"[[y]]\"\nend: 1\n---\nbody"
    assert one(spark, U.sources_in_order(F.col("t")), t=bad) == "---\ntitle: t\nsources:\n  - \"[[x]]\"\n  - \"[[y]]\"\nsource-hashes: [a]\nend: 1\n---\nbody"
    fine = "---\ntitle: t\nfidelity: low\n---\nfidelity: text"
    assert one(spark, U.sources_in_order(F.col("t")), t=fine) == fine
    assert one(spark, U.without_field(F.col("t"), "fidelity"), t=fine) == "---\ntitle: t\n---\nfidelity: text"
    assert one(spark, U.with_fields(F.col("t"), {"title": F.lit("z"), "kind": F.lit("note")}), t=fine) == "---\ntitle: t\nfidelity: low\nkind: note\n---\nfidelity: text"


def test_lists_keep_their_sizes(spark):
    urls = lambda n: spark.range(n).select(F.concat(F.lit("u"), F.lpad("id", 2, "0")).alias("url"))
    rows = U.bundle({"a": urls(30), "b": urls(3), "c": urls(0)}, {"a": 25}).collect()
    assert {(r["list"], r["total"]) for r in rows} == {("a", 30), ("b", 3)} and sum(r["list"] == "a" for r in rows) == 25
    found = spark.createDataFrame([("x", c) for c in "gfedcba"] + [("y", "z")], "category string, item string")
    assert {tuple(r) for r in U.tally(found, "category", "item").collect()} == {("x", 7, "a\nb\nc\nd\ne"), ("y", 1, "z")}
