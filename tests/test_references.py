"""Orphan references: small cases, and a hot key."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleanery.operators import references as R

DAY = dt.datetime
PAGES = "page_id long, updated_at timestamp, sources array<string>, source_hashes array<string>, extra string"
CLIPS = "path string, captured_at timestamp, source_hash string"
PURGES = "from_path string, restored_at timestamp"


@pytest.mark.parametrize(
    "link, name",
    [
        ("[[A]]", "A"), ('"[[raw/clippings/A b.md|x]]"', "A b"), ("[[ A.md#h ]]", "A"), ("[[x/A|y#z]]", "A"), ("raw/A.md", "A"), ("[[A.md.md]]", "A.md"), ("[[]]", ""),
    ],
)
def test_wikilink_name(spark, link, name):
    assert spark.createDataFrame([(link,)], "x string").select(R.wikilink_name(F.col("x"))).collect()[0][0] == name


def run(spark, pages, clips, purges):
    p, c, g = spark.createDataFrame(pages, PAGES), spark.createDataFrame(clips, CLIPS), spark.createDataFrame(purges, PURGES)
    entries, parents = R.reference_entries(p), R.usable_clips(c, c.limit(0), g)
    return {(r.page_id, r.field, r.pos) for r in R.orphans(entries, parents).collect()}


def test_missing_late_purged_and_restored(spark):
    clips = [("raw/A.md", DAY(2025, 1, 1), "AA"), ("raw/late.md", DAY(2025, 6, 1), "bb"), ("raw/gone.md", DAY(2025, 1, 1), "cc"), ("raw/back.md", DAY(2025, 1, 1), None), ("raw/twin.md", DAY(2025, 1, 1), "cc ")]
    purges = [("raw/gone.md", None), ("raw/back.md", DAY(2025, 2, 1)), (None, None)]
    pages = [
        (1, DAY(2025, 3, 1), ["[[A]]", None, " ", "[[late]]", "[[gone]]", "[[back]]", "[[none]]"], [" aa", "BB", "cc", "dd", ""], "x"),
        (2, DAY(2025, 6, 1), ["[[late]]"], None, None),
        (3, DAY(2025, 6, 1), [], [], None),
        (4, None, ["[[A]]"], None, None),
    ]
    assert run(spark, pages, clips, purges) == {(1, "sources", 4), (1, "sources", 5), (1, "sources", 7), (1, "source_hashes", 2), (1, "source_hashes", 4), (4, "sources", 1)}


def test_empty_tables(spark):
    assert run(spark, [], [], []) == set()
    assert run(spark, [(1, DAY(2025, 1, 1), ["[[A]]"], None, None)], [], []) == {(1, "sources", 1)}


def test_hot_key_takes_the_other_way_with_the_same_result(spark, monkeypatch):
    pages = [(i, DAY(2025, 1, 1) + dt.timedelta(days=i), ["[[hot]]", f"[[c{i % 7}]]"], None, None) for i in range(60)]
    clips = [("raw/hot.md", DAY(2025, 1, 20), None), ("raw/c1.md", DAY(2025, 1, 1), None)]
    some = run(spark, pages, clips, [])
    monkeypatch.setattr(R, "HOT_PARTS", 3)
    assert run(spark, pages, clips, []) == some
    assert {(i, "sources", 1) for i in range(19)} <= some and (19, "sources", 1) not in some


def test_report_counts_by_month(spark):
    p = spark.createDataFrame([(1, DAY(2025, 1, 5), ["[[A]]", "[[B]]"], None, None), (2, DAY(2025, 2, 5), ["[[A]]"], None, None)], PAGES)
    c = spark.createDataFrame([("x/A.md", DAY(2025, 1, 1), None), ("x/B.md", DAY(2025, 3, 1), None)], CLIPS)
    e, parents = R.reference_entries(p), R.usable_clips(c, c.limit(0), spark.createDataFrame([], PURGES))
    rows = {(r["field"], r["month"], r["n_refs"], r["n_orphans"], r["n_later"]) for r in R.orphan_report(e, R.orphans(e, parents)).collect()}
    assert rows == {("sources", "2025-01", 2, 1, 1), ("sources", "2025-02", 1, 0, 0)}
