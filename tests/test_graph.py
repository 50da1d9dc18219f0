"""A vault of files, read and measured; closure and reconciling; order of rows must not matter."""

import random

import pytest

from gleanery.operators import closure as C
from gleanery.operators import graph as G
from gleanery.sources import files as S

LONG = "word " * 20


def page(fm: str, body: str) -> str:
    return f"---\n{fm}\n---\n{body}\n"


VAULT = {
    "wiki/concepts/alpha.md": page('type: concept\nupdated: 2026-07-01\nsources: ["[[source-a]]"]', LONG + "[[beta]] [[source-a]]"),
    "wiki/concepts/beta.md": page('type: concept\nupdated: 2026-07-01\nsources: ["[[source-b]]"]', LONG),
    "wiki/concepts/gamma.md": page('type: concept\nupdated: 2026-07-01\nsources: ["[[source-a]]", "[[paper.pdf]]"]', LONG + "[[hub-stub]] [[delta]] [[nonexistent-page]]"),
    "wiki/concepts/delta.md": page('type: concept\nsources: ["[[source-a]]"]', LONG + "[[hub-stub]] [[epsilon]]"),
    "wiki/concepts/epsilon.md": page('type: concept\nsources: ["[[source-a]]"]', LONG + "[[hub-stub]] [[zeta]]"),
    "wiki/concepts/zeta.md": page('type: concept\nsources: ["[[source-a]]"]', LONG + "[[hub-stub]] [[eta]]"),
    "wiki/concepts/eta.md": page('type: concept\nsources: ["[[source-a]]"]', LONG + "[[hub-stub]] [[gamma]]"),
    "wiki/entities/orphan-entity.md": page("type: entity", "few words"),
    "wiki/sources/source-a-summary.md": page('type: source\nsource-hashes: [aaaaaa11]\nsources: ["[[raw/sources/source-a.md]]"]', LONG + "[[alpha]]"),
    "wiki/sources/no-provenance.md": page("type: source", LONG + "[[alpha]]"),
    "wiki/sources/declared.md": page("type: source\nsources: []", LONG + "[[alpha]]"),
    "wiki/concepts/said.md": page("type: concept\nstatus: draft\nsources: []", LONG + "[[alpha]]"),
    "wiki/syntheses/hub-stub.md": page('type: synthesis\nstatus: stub\nsources: ["[[gone-source]]"]', "short"),
    "wiki/syntheses/root.md": page('type: synthesis\nsources: ["[[source-a]]"]', LONG + "[[alpha]] [[gamma]] [[source-a-summary]] [[no-provenance]] [[declared]] [[said]]"),
    "raw/sources/source-a.md": page("source-hash: AAAAAA11", LONG),
    "raw/sources/source-b.md": page("source-hash: bbbbbb11", LONG),
    "raw/sources/paper.pdf": "%PDF",
    "raw/clippings/unparsed.md": page("title: x", LONG + "[[missing-from-raw]]"),
    "index.md": "[[orphan-entity]] [[alpha]]",
    ".recycle/p/wiki/concepts/dead.md": "gone",
}


@pytest.fixture(scope="module")
def vault(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    for name, text in VAULT.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    pages = S.scan(spark, str(root)).cache()
    return pages, G.resolve(S.links_of(pages), pages).cache()


def paths(df, column="path"):
    return {r[column] for r in df.select(column).collect()}


def test_scan(vault):
    pages = {r["path"]: r for r in vault[0].collect()}
    assert set(pages) == {p for p in VAULT if not p.startswith(".")}
    assert pages["raw/sources/paper.pdf"]["type"] == "attachment" and pages["raw/sources/paper.pdf"]["name"] == "paper.pdf"
    a = pages["wiki/sources/source-a-summary.md"]
    assert a["source_hashes"] == ["aaaaaa11"] and a["fm_targets"] == ["raw/sources/source-a.md"] and a["out_targets"] == ["alpha"] and a["words"] == 21


def test_metrics(vault):
    pages, resolved = vault
    assert paths(G.orphans(pages, resolved)) == {"wiki/entities/orphan-entity.md"}
    assert paths(G.dead_ends(pages, resolved)) == {"wiki/concepts/beta.md", "wiki/entities/orphan-entity.md", "wiki/syntheses/hub-stub.md"}
    assert {tuple(r) for r in G.broken(resolved).collect()} == {("wiki/concepts/gamma.md", "nonexistent-page"), ("wiki/syntheses/hub-stub.md", "gone-source")}
    assert {tuple(r) for r in G.hub_stubs(pages, resolved).collect()} == {("wiki/syntheses/hub-stub.md", 5)}
    assert paths(G.unreachable(pages, resolved)) == {"wiki/entities/orphan-entity.md", "wiki/syntheses/hub-stub.md"}
    assert paths(G.provenance_gaps(pages, resolved)) == {"wiki/sources/no-provenance.md"}
    assert paths(G.declared_gaps(pages, resolved)) == {"wiki/sources/declared.md", "wiki/concepts/said.md"}
    assert paths(G.declared_stubs(pages)) == {"wiki/syntheses/hub-stub.md"}
    assert paths(G.backlog(pages, resolved)) == {"raw/sources/source-b.md", "raw/clippings/unparsed.md"}
    assert paths(G.unparsed(pages, resolved)) == {"raw/clippings/unparsed.md"}
    assert paths(G.missing_hash(pages)) == {"raw/clippings/unparsed.md"}


def test_resolution_prefers_names_then_content(spark):
    pages = spark.createDataFrame([("raw/x.md", "x", None), ("wiki/concepts/x.md", "x", None), ("a/y.md.md", "y.md", None)], "path string, name string, title string")
    links = spark.createDataFrame([("s.md", 0, "nav", "X"), ("s.md", 1, "prov", "X"), ("s.md", 2, "prov", "wiki/concepts/X.md"), ("s.md", 3, "nav", "y.md"), ("s.md", 4, "nav", "q/none"), ("s.md", 5, "nav", "q/x")], "source string, pos int, channel string, target string")
    got = {r["pos"]: r["landed"] for r in G.resolve(links, pages).collect()}
    assert got == {0: "wiki/concepts/x.md", 1: "raw/x.md", 2: "wiki/concepts/x.md", 3: "a/y.md.md", 4: None, 5: "wiki/concepts/x.md"}


def test_suggestions_equal_brute_force(spark):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(120)})
    targets = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(60)})
    pages = spark.createDataFrame([(f"wiki/{n}.md", n, n, "x") for n in names], "path string, name string, title string, status string")
    got = {r["target"]: r["suggest"] for r in G.suggestions(spark.createDataFrame([(t,) for t in targets], "target string"), pages).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    for t in targets:
        near = [n for n in names if distance(t, n) <= 2]
        assert got.get(t) == (min(near) if near and t not in names else got.get(t) if near else None)
        assert (t in got) == bool(near)


def test_broken_links_are_classified(vault):
    pages, _ = vault
    bad = pages.sparkSession.createDataFrame([("wiki/concepts/gamma.md", "alpa"), ("wiki/concepts/gamma.md", "two\nlines"), ("wiki/concepts/gamma.md", "unknown thing")], "source string, target string")
    late = {r["target"]: (r["class"], r["suggest"]) for r in G.classify_broken(bad, pages, "2027-07-01").collect()}
    assert late == {"alpa": ("defect", "alpha"), "two\nlines": ("defect", None), "unknown thing": ("stale", None)}
    spark = pages.sparkSession
    wrapped = spark.createDataFrame([("wiki/concepts/gamma.md", "hub-\nstub"), ("wiki/concepts/gamma.md", "alp\nhx")], "source string, target string")
    assert {r["target"]: r["suggest"] for r in G.classify_broken(wrapped, pages, "2027-07-01").collect()} == {"hub-\nstub": "hub-stub", "alp\nhx": None}
    assert {r["class"] for r in G.classify_broken(bad.filter("target = 'unknown thing'"), pages, "2026-07-02").collect()} == {"deferred"}


def test_health(spark):
    counts = spark.createDataFrame([("orphans", 1), ("dead_ends", 3), ("provenance_gaps", 1), ("unreachable", 2)], "finding string, n long")
    assert G.health(counts).collect()[0]["score"] == 100 - 2 - 6 - 4 - 6


def test_closure_takes_what_only_the_set_refers_to(spark):
    refs = [("raw/only.md", "wiki/t.md"), ("raw/shared.md", "wiki/t.md"), ("raw/shared.md", "wiki/o.md"), ("wiki/sub.md", "wiki/t.md"), ("raw/deep.md", "wiki/sub.md"), ("raw/only.md", "moc/m.md"), ("moc/m.md", "wiki/t.md"), ("wiki/t.md", "wiki/o.md")]
    for seed in range(3):
        random.Random(seed).shuffle(refs)
        r = spark.createDataFrame(refs, "path string, referrer string")
        taken = C.closure(r, spark.createDataFrame([("wiki/t.md",)], "path string"))
        assert {x["path"]: x["round"] for x in taken.collect()} == {"wiki/t.md": 0, "raw/only.md": 1, "wiki/sub.md": 1, "raw/deep.md": 2}
    assert {x["path"]: x["n"] for x in C.collateral(r, taken).collect()} == {"wiki/o.md": 1, "moc/m.md": 1}


def test_closure_has_no_limit_of_rounds(spark):
    chain = spark.createDataFrame([(f"p{i + 1}", f"p{i}") for i in range(102)], "path string, referrer string").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        taken = C.closure(chain, spark.createDataFrame([("p0",)], "path string"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r["path"]: r["round"] for r in taken.collect()} == {f"p{i}": i for i in range(103)}


def test_monoliths_are_authored_long_and_updated(spark):
    rows = [("wiki/authored/a.md", 3001, 3), ("wiki/authored/b.md", 3000, 9), ("wiki/authored/c.md", 9000, 2), ("wiki/syntheses/d.md", 9000, 9)]
    assert paths(G.monoliths(spark.createDataFrame(rows, "path string, words int, callouts int"))) == {"wiki/authored/a.md"}


def test_links_of_large_chunk_ids_keep_their_order(spark, tmp_path):
    import datetime as dt

    from gleanery.operators import vault as V

    spark.createDataFrame([(1, "wiki/a.md", [], dt.datetime(2025, 1, 1))], "page_id long, path string, sources array<string>, loaded_at timestamp").write.parquet(f"{tmp_path}/wiki_pages.parquet")
    many = " ".join(f"[[t{i}]]" for i in range(1100))
    rows = [(3 * 10**9, "wiki/a.md", many, dt.datetime(2025, 1, 1)), (3 * 10**9 + 1, "wiki/a.md", "[[last]]", dt.datetime(2025, 1, 1))]
    spark.createDataFrame(rows, "chunk_id long, path string, text string, loaded_at timestamp").write.parquet(f"{tmp_path}/chunks.parquet")
    got = [r["target"] for r in V.links(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == [f"t{i}" for i in range(1100)] + ["last"]


def test_blocking(spark):
    resolved = spark.createDataFrame([("wiki/a.md", "prov", "raw/x.md"), ("wiki/b.md", "prov", "raw/x.md"), ("wiki/b.md", "prov", "raw/y.md"), ("wiki/c.md", "nav", "raw/x.md")], "source string, channel string, resolved string")
    assert paths(C.blocking(resolved, spark.createDataFrame([("raw/x.md",)], "path string"))) == {"wiki/a.md"}


def test_reconcile_claims_each_file_once(spark):
    entries = [("p2", 1, "raw/a.md", "H1"), ("p1", 1, "raw/a.md", "h1"), ("p1", 2, "raw/b.md", "h2"), ("p3", 1, "raw/none.md", "h3"), ("p3", 2, "raw/none.md", None)]
    pages = [("raw/a.md", "h9"), ("raw/copy1.md", "h1"), ("raw/b2.md", "H2"), ("raw/b3.md", "h2")]
    for seed in range(3):
        random.Random(seed).shuffle(entries)
        got = C.reconcile(spark.createDataFrame(entries, "purge_id string, entry int, from_path string, source_hash string"), spark.createDataFrame(pages, "path string, source_hash string"))
        assert {tuple(r) for r in got.collect()} == {("raw/a.md", "p1", "path"), ("raw/copy1.md", "p2", "source-hash"), ("raw/b2.md", "p1", "source-hash"), ("raw/b3.md", "p1", "source-hash")}


def test_walk_is_limited_and_starts_with_evidence(spark):
    edges = spark.createDataFrame([("c", "raw/1"), ("raw/1", "x"), ("x", "raw/2"), ("raw/2", "raw/3"), ("c", "y"), ("y", "raw/4")], "source string, target string")
    got = G.evidence_walk(edges, spark.createDataFrame([("c",)], "path string"), lambda c: c.startswith("raw/"))
    assert paths(got, "evidence") == {"raw/1", "raw/2"}
