"""Neighbours against brute force, and vectors that take no part."""

import numpy as np

from gleanery.llm import neighbours as N

SCHEMA = "slot long, embedding array<float>, key string, curve int, code string"


def frame(spark, rows):
    return spark.createDataFrame([(s, v, "x", 1, None) for s, v in rows], SCHEMA)


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((n // 10, 96))
    x = centers[rng.integers(0, len(centers), n)] + 0.45 * rng.standard_normal((n, 96))
    return x * rng.uniform(0.1, 20, (n, 1))


def test_recall_against_brute_force(spark):
    x = clustered(1500)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    sim = unit @ unit.T
    np.fill_diagonal(sim, -2)
    near = np.argsort(-sim, axis=1)[:, :8]
    true = {(min(i, j), max(i, j)) for i in range(len(x)) for j in map(int, near[i]) if sim[i, j] >= 0.8}
    got = {tuple(r) for r in N.similar_pairs(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), least=0.8, window=128).collect()}
    assert len(true) > 1000 and len(true & got) / len(true) >= 0.95
    assert all(sim[a, b] >= 0.799 for a, b in got)


def test_small_sets_are_exact_and_places_are_ordered(spark):
    x = clustered(90, 3)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    sim = unit @ unit.T
    np.fill_diagonal(sim, -2)
    rows = N.nearest(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)] * 2), k=3).collect()
    assert len(rows) == 270
    best = {(r["slot"], r["place"]): r["other"] for r in rows}
    assert sum(best[i, 1] == int(np.argmax(sim[i])) for i in range(90)) == 90


def test_what_takes_no_part(spark):
    v = [1.0] * 96
    rows = [(1, v), (1, v), (2, [2.0] * 96), (3, None), (4, [0.0] * 96), (5, [1.0] * 48), (6, [float("nan")] * 96), (None, v), (7, [-1.0] * 96)]
    assert {tuple(r) for r in N.similar_pairs(frame(spark, rows)).collect()} == {(1, 2)}
    assert N.similar_pairs(frame(spark, [])).count() == 0
    assert N.nearest(frame(spark, [(1, v)])).count() == 0


def test_copies_of_one_vector_share_a_key_and_still_get_their_k(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    rows = [(i, [1.0] * 96) for i in range(400)]
    out = N.nearest(frame(spark, rows), k=8, least=0.85, window=32).groupBy("slot").count().collect()
    assert len(out) == 400 and all(r["count"] == 8 for r in out)


def test_near_copies_of_an_overfull_cell_find_their_nearest(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "PART", 150, raising=False)
    rng = np.random.default_rng(5)
    x = np.concatenate([clustered(600, 4), rng.standard_normal(96) + 0.02 * rng.standard_normal((600, 96))])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    sim = unit @ unit.T
    np.fill_diagonal(sim, -2)
    near = np.argsort(-sim, axis=1)[:, :8]
    got = {(r["slot"], r["other"]) for r in N.nearest(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), least=0.85, window=32).collect()}
    true = {(i, int(j)) for i in range(600, 1200) for j in near[i]}
    assert len(true & got) / len(true) >= 0.95


def test_copies_are_ranked_by_slot_before_others(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    near = [1.0] * 95 + [1.01]
    rows = [(i, [1.0] * 96) for i in range(10, 310)] + [(i, near) for i in range(5)]
    got = {}
    for r in N.nearest(frame(spark, rows), k=8, window=32).collect():
        got.setdefault(r["slot"], {})[r["place"]] = r["other"]
    assert all([got[i][p] for p in range(1, 9)] == [j for j in range(10, 20) if j != i][:8] for i in range(10, 310))
    assert all([got[i][p] for p in range(1, 9)] == [j for j in range(5) if j != i] + [10, 11, 12, 13] for i in range(5))


def test_hilbert_keys_are_a_walk_of_single_steps():
    cells = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    keys = N.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
