"""Ranking, fusion, drift, upkeep of the index, chunks, lexical search."""

import math
import random

from pyspark.sql import functions as F

from gleanery.operators import chunking as K
from gleanery.operators import search as S
from gleanery.operators import vectors as X
from gleanery.sources import sinks


def rows(spark, data):
    return spark.createDataFrame(data, "path string, position int, embedding array<float>")


def test_mean_of_chunks_and_best_line(spark):
    df = rows(spark, [("a", 1, [1.0, 0.0]), ("a", 90, [0.0, 1.0]), ("b", 5, [-1.0, 0.0]), ("c", 1, [0.0, 0.0]), ("d", 1, None), ("e", 1, [1.0])])
    got = {r["path"]: (round(r["score"], 6), r["best_position"]) for r in X.rank_by_mean(df, [1.0, 0.0], "path", "position", "embedding").collect()}
    assert got == {"a": (0.707107, 1), "b": (-1.0, 5), "c": (0.0, 1)}
    best = X.rank_by_best(df, [0.0, 1.0], "path", "position", "embedding").collect()
    assert (best[0]["path"], best[0]["best_position"], best[0]["score"]) == ("a", 90, 1.0)


def test_equal_scores_are_ordered_by_binary_path_and_first_chunk(spark):
    df = rows(spark, [(p, i, [1.0, 1.0]) for p in ("Zebra", "apple", "Apple") for i in (3, 2)])
    got = X.rank_by_mean(df, [1.0, 1.0], "path", "position", "embedding").collect()
    assert [(r["path"], r["best_position"], r["n"]) for r in got] == [("Apple", 2, 2), ("Zebra", 2, 2), ("apple", 2, 2)]


def test_fusion(spark):
    mk = lambda xs: spark.createDataFrame([(x, i + 1) for i, x in enumerate(xs)], "path string, rank int")
    got = X.fuse([mk(["x", "y"]), mk(["y", "z"])], "path").collect()
    assert [r["path"] for r in got] == ["y", "x", "z"] and math.isclose(got[0]["fused"], 1 / 62 + 1 / 61)


def test_upkeep(spark):
    chunks = spark.createDataFrame([("f", "h1"), ("f", "h2"), ("g", "h2"), ("g", None)], "path string, hash string")
    vectors = spark.createDataFrame([("h1", [1.0]), ("h9", [1.0]), ("h2", None)], "hash string, embedding array<float>")
    assert tuple(X.coverage(chunks, vectors).collect()[0]) == (2, 4, 1, 3)
    assert [r["hash"] for r in X.needed_hashes(chunks, vectors).collect()] == ["h2"]
    assert {r["hash"] for r in X.stale_vectors(vectors, chunks.filter("hash is not null")).collect()} == {"h9"}
    old = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", None, 5), ("d", 1, 1)], "path string, mtime int, size int")
    new = spark.createDataFrame([("a", 1, 5), ("b", 2, 5), ("c", None, 5), ("e", 1, 1)], "path string, mtime int, size int")
    assert {tuple(r) for r in X.manifest_diff(old, new, "path", ["mtime", "size"]).collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "unchanged"), ("d", "removed"), ("e", "added")}
    assert [r["path"] for r in X.repair_paths(chunks, vectors, spark.createDataFrame([("g",)], "path string")).collect()] == ["g"]


def test_drift(spark):
    pages = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [0.0, 1.0]), ("r", [1.0, 1.0])], "page string, embedding array<float>")
    edges = spark.createDataFrame([("p", "s1"), ("q", "s1"), ("p", "s2")], "page string, source string")
    sources = spark.createDataFrame([("s1", [2.0, 0.0]), ("s2", [2.0, 2.0])], "source string, embedding array<float>")
    got = {r["page"]: (r["n_sources"], r["drifted"], round(r["similarity"], 4)) for r in X.drift(pages, edges, sources, "page", "source", "embedding", 2).collect()}
    assert got == {"p": (2, False, 0.8944), "q": (1, True, 0.0)}


def test_bm25_equals_its_formula(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["Red", "green", "blue,", "x"]) for _ in range(rng.randint(1, 30)))) for i in range(50)] + [(90, None), (91, "")]
    words = {i: [w for w in (t or "").lower().replace(",", " ").split()] for i, t in docs}
    mean = sum(map(len, words.values())) / len(words)

    def score(i):
        s = 0.0
        for t in ("blue", "red"):
            tf, df = words[i].count(t), sum(t in w for w in words.values())
            s += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[i]) / mean))
        return s

    want = sorted((i for i in words if score(i) > 0), key=lambda i: (-score(i), i))[:10]
    got = S.bm25(spark.createDataFrame(docs, "doc_id int, text string"), "RED blue red", "doc_id", "text").collect()
    assert [r["doc_id"] for r in got] == want and all(math.isclose(r["score"], score(r["doc_id"])) for r in got)
    assert S.bm25(spark.createDataFrame(docs, "doc_id int, text string"), " ", "doc_id", "text").count() == 0


def test_search_falls_back_to_words(spark):
    docs = spark.createDataFrame([("a", "red"), ("b", "blue")], "path string, text string")
    assert [r["path"] for r in S.search(docs, None, "red", None, "path", "text").collect()] == ["a"]
    both = S.search(docs, rows(spark, [("b", 1, [1.0, 0.0])]), "red", [1.0, 0.0], "path", "text").collect()
    assert [r["path"] for r in both] == ["a", "b"]


def test_chunks_cover_lines_and_carry_headings():
    text = "---\ntitle: x\nsource-hash: abcdef12\ntags: [a]\n---\n# Top\nintro\n\n" + "".join(f"## S{i}\n" + ("word " * 60 + "\n\n") * 4 for i in range(6)) + "y" * 5000 + "\n"
    got = K.chunk_markdown(text, "Title")
    assert got[0][1] == 1 and "tags: [a]" in got[0][0] and "source-hash" not in got[0][0]
    assert all("tags: [a]" not in c[0] for c in got[1:]) and all(c[0].startswith("Title") for c in got)
    for a, b in zip(got, got[1:]):
        assert a[2] >= b[1] - 1 and a[1] <= b[1]
    lines = {n for _, a, b, _ in got for n in range(a, b + 1)}
    assert set(range(1, text.count("\n") + 1)) <= lines
    assert any(c[3] == "Top › S3" for c in got) and max(len(c[0]) for c in got) < 1200 * 1.5 + 400
    assert K.chunk_markdown("", "t") == [] and K.chunk_markdown("---\na: 1\n---\n", "t")[0][1] == 1


def test_published_versions_switch_at_once(spark, tmp_path):
    root = str(tmp_path)
    assert sinks.published(spark, root, "index") is None
    sinks.publish(spark.range(3), root, "index")
    sinks.publish(spark.range(5), root, "index")
    assert sinks.published(spark, root, "index").count() == 5
    key = lambda df: F.lower(df["url"])
    store = spark.createDataFrame([("A", "x"), ("b", "y")], "url string, reason string")
    up = sinks.upserted(store, spark.createDataFrame([("a", "z")], "url string, reason string"), key)
    assert {tuple(r) for r in up.collect()} == {("a", "z"), ("b", "y")}
    assert {tuple(r) for r in sinks.removed(up, spark.createDataFrame([("B", "no"), ("A", "z")], "url string, reason string"), key, ["reason"]).collect()} == {("b", "y")}
