"""Upkeep of the index over several states, with failing providers; the desk on literals."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from gleanery.operators import desk, refresh
from gleanery.sources import sinks

FILES = "path string, title string, text string, mtime int, size int"


def files(spark, rows):
    return spark.createDataFrame([(p, "T", t, m, len(t)) for p, t, m in rows], FILES)


def test_refresh_is_incremental_and_idempotent(spark, tmp_path):
    root = str(tmp_path)
    first = files(spark, [("a.md", "# A\nalpha beta", 1), ("b.md", "# B\ngamma", 1), ("c.md", "# B\ngamma", 1)])
    assert refresh.refresh(spark, first, root) == {"changed": 3, "embedded": 2, "failed": 0, "dropped": 0}
    assert refresh.refresh(spark, first, root) == {"changed": 0, "embedded": 0, "failed": 0, "dropped": 0}
    second = files(spark, [("a.md", "# A\nalpha delta", 2), ("c.md", "# B\ngamma", 1)])
    assert refresh.refresh(spark, second, root) == {"changed": 2, "embedded": 1, "failed": 0, "dropped": 1}
    assert {r["path"] for r in sinks.published(spark, root, "chunks").collect()} == {"a.md", "c.md"}
    assert sinks.published(spark, root, "vectors").count() == 2


def test_one_bad_text_costs_one_vector_and_is_tried_again(spark, tmp_path):
    def bad(texts):
        if any("poison" in t for t in texts):
            raise ValueError("cannot embed")
        return refresh.hashed(texts)

    root = str(tmp_path)
    f = files(spark, [("a.md", "poison", 1), ("b.md", "good", 1), ("c.md", "fine", 1)])
    assert refresh.refresh(spark, f, root, bad) == {"changed": 3, "embedded": 2, "failed": 1, "dropped": 0}
    assert refresh.refresh(spark, f, root) == {"changed": 0, "embedded": 1, "failed": 0, "dropped": 0}


def test_if_all_fail_the_index_stays(spark, tmp_path):
    def broken(texts):
        raise ValueError("down")

    root = str(tmp_path)
    refresh.refresh(spark, files(spark, [("a.md", "one", 1)]), root)
    with pytest.raises(RuntimeError, match="down"):
        refresh.refresh(spark, files(spark, [(f"{i}.md", f"text {i}", 2) for i in range(3)]), root, broken)
    assert {r["path"] for r in sinks.published(spark, root, "chunks").collect()} == {"a.md"}


def test_hashed_vectors():
    a, b, c = refresh.hashed(["Red green", "green red", ""])
    assert a == b and math.isclose(sum(x * x for x in a), 1) and not any(c)


def test_candidates(spark):
    found = spark.createDataFrame([("https://e.com/a#x",), ("https://E.com/a",), ("https://bad.org/x",), ("https://e.com/known/",), ("https://e.com/no",), (None,)], "url string")
    known = spark.createDataFrame([("https://e.com/known",), (None,)], "url string")
    got = desk.candidates(found, known, spark.createDataFrame([("bad.org",)], "domain string"), spark.createDataFrame([("https://e.com/no",)], "url_key string"))
    assert [r["url_key"] for r in got.collect()] == ["https://e.com/a"]


def test_queue_covers_citers_and_classes(spark):
    items = spark.createDataFrame([("A b", "x"), (" a  B", "y"), (None, "x"), ("c", "x")], "topic string, grp string")
    assert {tuple(r) for r in desk.queue(items, "topic", "grp", "a b").collect()} == {("x", 1), ("y", 1)}
    assert desk.queue(items, "topic", "grp").agg(F.sum("n")).collect()[0][0] == 4 and [tuple(r) for r in desk.queue(items, "topic", "grp", "").collect()] == [("x", 1)]
    resolved = spark.createDataFrame([("wiki/sources/b.md", "raw/x.md"), ("wiki/sources/a.md", "raw/x.md"), ("wiki/a.md", "raw/y.md")], "source string, resolved string")
    assert [tuple(r) for r in desk.covers(resolved).collect()] == [("raw/x.md", "wiki/sources/a.md")]
    broken_links = spark.createDataFrame([("p", "a.PDF"), ("q", "a.PDF"), ("p", "note")], "source string, target string")
    assert [tuple(r) for r in desk.binary_citers(broken_links).collect()] == [("a.PDF", 2, "p")]
    df = spark.createDataFrame([("ab",), ("b",), (None,)], "x string")
    assert [r[0] for r in df.select(desk.classify(df, "x", [("a", "one"), ("b", "two")], "-")).collect()] == ["one", "two", "-"]
    clips = spark.createDataFrame([("raw/2.md", "see my_file.pdf and x.docx"), ("raw/1.md", "from my_file.pdf"), ("raw/3.md", " " * 700 + "late.pdf")], "path string, md string")
    assert {tuple(r) for r in desk.holds_path(spark.createDataFrame([("C:\\s\\my_file.pdf",), ("late.pdf",)], "path string"), clips).collect()} == {("C:\\s\\my_file.pdf", "raw/1.md")}


def test_notices_and_tiers():
    now = dt.datetime(2026, 1, 1, 12)
    assert desk.should_announce(None, now) and desk.should_announce(now - dt.timedelta(hours=4), now) and not desk.should_announce(now - dt.timedelta(hours=3), now)
    assert desk.tier(True, 5, 2) == ("hybrid", ["2 chunks without a vector"]) and desk.tier(False, 0, 0)[0] == "lexical"
