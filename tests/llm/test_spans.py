"""Shared spans against brute force over all windows."""

import random
from collections import defaultdict

import pytest

from gleanery.llm import spans as S

SCHEMA = "doc_id long, text string, h string, source string"


def brute(docs, length):
    where = defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - length + 1):
            where[t[i : i + length]].add(d)
    pairs, covered = set(), defaultdict(set)
    for ds in where.values():
        pairs |= {(a, b) for a in ds for b in ds if a < b}
    for d, t in docs:
        for i in range(len(t or "") - length + 1):
            if len(where[t[i : i + length]]) > 1:
                covered[d] |= set(range(i, i + length))
    return pairs, covered


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcde fgh\nä😀漢") for _ in range(n))
    blocks = [text(n) for n in (199, 200, 201, 260, 420, 900)]
    docs = []
    for d in range(40):
        parts = [text(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            b = rng.choice(blocks)
            parts += [b if rng.random() < 0.7 else b[: rng.randint(150, len(b))], text(rng.randint(0, 150))]
        docs.append((d, "".join(parts)))
    docs += [(100, None), (101, ""), (102, "short"), (103, blocks[3]), (104, blocks[3]), (105, "aaaa " * 200), (106, "aaaa " * 90)]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "clash", None) for d, t in docs + docs[:5]], SCHEMA)


@pytest.mark.parametrize("hot, block", [(256, 1 << 19), (2, 1 << 19), (4, 700)])
def test_pairs_and_intervals_equal_brute_force(spark, monkeypatch, hot, block):
    monkeypatch.setattr(S, "HOT", hot)
    docs = corpus(hot + block)
    if block < 1000:
        monkeypatch.setattr(S, "_BLOCK", block)
    pairs, covered = brute(docs, 200)
    df = frame(spark, docs)
    assert {tuple(r) for r in S.shared_pairs(df).collect()} == pairs
    got = defaultdict(set)
    rows = S.shared_intervals(df).collect()
    for r in rows:
        assert r["end"] - r["start"] >= 200
        got[r["doc_id"]] |= set(range(r["start"], r["end"]))
    assert got == covered
    byd = defaultdict(list)
    for r in rows:
        byd[r["doc_id"]].append((r["start"], r["end"]))
    assert all(a[1] < b[0] for v in byd.values() for a, b in zip(sorted(v), sorted(v)[1:]))


def test_empty_table_and_report(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.shared_pairs(empty).count() == 0 and S.shared_intervals(empty).count() == 0
    df = frame(spark, [(1, "x" * 50 + "y" * 250), (2, "y" * 250), (3, None)])
    rep = {r["doc_id"]: (r["n_chars"], r["n_spans"], r["shared_chars"]) for r in S.shared_report(df, S.shared_intervals(df)).collect()}
    assert rep == {1: (300, 1, 250), 2: (250, 1, 250), 3: (0, 0, 0)}


def test_hot_hash_is_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 8)
    rng = random.Random(1)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(230))
    docs = [(d, "".join(rng.choice("ijk") for _ in range(60)) + shared + str(d) * 40) for d in range(60)]
    got = {tuple(r) for r in S.shared_pairs(frame(spark, docs)).collect()}
    assert got == {(a, b) for a in range(60) for b in range(a + 1, 60)}


@pytest.mark.parametrize("filtered, few", [(3, 0), (1 << 25, 0)])
def test_ranges_of_filters_and_salted_joins_lose_nothing(spark, monkeypatch, filtered, few):
    monkeypatch.setattr(S, "FILTERED", filtered)
    monkeypatch.setattr(S, "FEW", few)
    monkeypatch.setattr(S, "HOT", 3)
    docs = corpus(7)[::2]
    pairs, covered = brute(docs, 200)
    df = frame(spark, docs)
    assert {tuple(r) for r in S.shared_pairs(df).collect()} == pairs
    got = defaultdict(set)
    for r in S.shared_intervals(df).collect():
        got[r["doc_id"]] |= set(range(r["start"], r["end"]))
    assert got == covered


def test_every_window_counted_gives_the_same(spark):
    docs = corpus(11)
    pairs, covered = brute(docs, 200)
    df = frame(spark, docs)
    assert {tuple(r) for r in S.shared_pairs(df, gram=200).collect()} == pairs
    got = defaultdict(set)
    for r in S.shared_intervals(df, gram=200).collect():
        got[r["doc_id"]] |= set(range(r["start"], r["end"]))
    assert got == covered


def test_links_of_classes(spark):
    docs = corpus(13) + [(200 + i, corpus(13)[0][1]) for i in range(3)] + [(300 + i, "short") for i in range(3)]
    pairs, _ = brute(docs, 200)
    links = defaultdict(int)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    rows = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in S.shared_links(frame(spark, docs)).collect()}
    first = {}
    for d, t in docs:
        if t is not None:
            first.setdefault(t, d)
    assert rows == {d: (first[t], links[d]) for d, t in docs if t is not None}
