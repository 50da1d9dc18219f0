"""Event folds in batch and as a stream; topics."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import events as E
from gleanery.operators import topics
from gleanery.sources import files, sinks
from gleanery.streaming import issues

LOG = "seq long, url string, kind string, reason string, title string, at timestamp, is_issue boolean, is_disposition boolean"
T = dt.datetime(2026, 1, 1)


def event(seq, url, what, reason=None, title=None):
    return (seq, url, "failed", reason, title, T + dt.timedelta(hours=seq), what == "i", what == "d")


def log(spark, rows, seed=0):
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, LOG)


ROWS = [event(1, "a", "i", "403", "T"), event(2, "a", "i", "404"), event(3, "b", "i"), event(4, "b", "d"), event(5, "c", "d"), event(6, "c", "i", "x"), event(7, "c", "i"), event(8, None, "i"), event(9, "e", "-")]


@pytest.mark.parametrize("seed", range(3))
def test_open_issues_keep_what_is_known_and_reopen(spark, seed):
    got = {r["url"]: r for r in E.open_issues(log(spark, ROWS, seed), ["url", "kind"], "at", ["reason"], ["title"]).collect()}
    assert set(got) == {"a", "c"}
    assert (got["a"]["occurrences"], got["a"]["reason"], got["a"]["title"]) == (2, "404", "T")
    assert (got["c"]["occurrences"], got["c"]["reason"], got["c"]["first_seen"]) == (2, None, T + dt.timedelta(hours=6))


def test_settled_and_latest(spark):
    df = log(spark, ROWS)
    assert {r["url"] for r in E.settled(df, ["url", "kind"]).collect()} == {"b"}
    assert {(r["url"], r["seq"]) for r in E.latest_disposition(df, ["url"], ["reason"]).collect()} == {("b", 4), ("c", 5)}
    flagged = spark.createDataFrame([("a", "failed"), ("b", "failed"), ("z", "failed")], "url string, kind string")
    left = E.without_settled(flagged, E.open_issues(df, ["url", "kind"], "at", [], []), E.settled(df, ["url", "kind"]), ["url", "kind"])
    assert [r["url"] for r in left.collect()] == ["z"]


def test_declines_end(spark):
    df = spark.createDataFrame([("old", T), ("edge", T + dt.timedelta(days=10)), ("new", T + dt.timedelta(days=100))], "url string, at timestamp").withColumn("day", F.to_date("at"))
    assert {r["url"] for r in E.unexpired(df, "day", "2026-07-10").collect()} == {"edge", "new"}
    assert {(r["url"], r["days_left"]) for r in E.nearing_expiry(df, "at", "2026-06-29 12:00:00").collect()} == {("old", 1), ("edge", 11)}


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    rng = random.Random(3)
    rows = [event(i, rng.choice("abcdef"), rng.choice("iiid")) for i in range(120)]
    source = tmp_path / "in"
    for n in range(4):
        log(spark, rows[30 * n : 30 * n + 30]).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(source))
        issues.run(stream, ["url", "kind"], "at", str(tmp_path / "out"))
        want = {(r["url"], r["first_seen"], r["last_seen"], r["occurrences"]) for r in E.open_issues(log(spark, rows[: 30 * n + 30]), ["url", "kind"], "at", [], []).collect()}
        last = max((tmp_path / "out").glob("state-*"), key=lambda p: int(p.name[6:]))
        got = {(r["url"], r["first_seen"], r["last_seen"], r["occurrences"]) for r in spark.read.parquet(str(last)).filter("occurrences > 0").collect()}
        assert got == want


def test_log_skips_broken_lines_and_kinds_are_checked(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"url": "a", "kind": "thin"}\n\nnot json\n{"url": "b", "kind": "failed"}\n')
    rows = files.event_log(spark, str(path), "url string, kind string").orderBy("seq").collect()
    assert [(r["url"], r["kind"]) for r in rows] == [("a", "thin"), ("b", "failed")]
    sinks.append_events(spark.createDataFrame([("c", "thin")], "url string, kind string"), str(tmp_path / "out"))
    with pytest.raises(Exception, match="unknown kind"):
        sinks.append_events(spark.createDataFrame([("d", "odd"), ("e", "thin")], "url string, kind string"), str(tmp_path / "out"))
    assert [json.loads(x)["url"] for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()] == ["c"]


def test_topics(spark):
    clips = spark.createDataFrame([("raw/1.md", "https://e.com/a/", " Quiet  Place "), ("raw/2.md", "https://e.com/b", "quiet place"), ("raw/3.md", None, None)], "path string, source string, topic string")
    items = spark.createDataFrame([("https://E.com/a#x", None, None), (None, "RAW/2.md", " "), ("https://e.com/a", "raw/2.md", "own"), (None, None, None)], "url string, path string, topic string")
    got = sorted((r["attributed"] or "-") for r in topics.attribute(items, clips).collect())
    assert got == ["-", "Quiet Place", "own", "quiet place"]
    groups = topics.topic_groups(clips, "topic", "path").orderBy("place").collect()
    assert [(r["topic_key"], r["label"], r["n"]) for r in groups] == [("quiet place", "Quiet Place", 2), ("", "Unattributed", 1)]
