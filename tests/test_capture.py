"""Capturing, linting, catalogs, repairs and files, on literals."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from gleanery.functions.urls import url_key
from gleanery.operators import capture as C
from gleanery.operators import catalog, lint, repair
from gleanery.operators.closure import bin_paths, restore_plan
from gleanery.sources import files


@pytest.mark.parametrize(
    "text, degraded",
    [("plain words stand here " * 30, False), ("a ? b " * 20, True), ("Why? Yes. " * 40, False), ("(cid:12)" * 6 + " w " * 50, True), ("w � " * 10, True), ("345 #$% 99 " * 60, True), (None, False), ("", False)],
)
def test_fidelity(spark, text, degraded):
    assert C.fidelity(spark.createDataFrame([(text,)], "t string"), "t").collect()[0]["degraded"] is degraded


def test_running_lines_and_tabularity(spark):
    pages = "\f".join(f"Head {i}\nbody {i} x\n\n{i}" for i in range(5))
    got = {tuple(r) for r in C.running_lines(spark.createDataFrame([(1, pages), (2, "a\fb"), (3, None)], "id int, t string"), "id", "t").collect()}
    assert got == {(1, "Head #", 5), (1, "#", 5)}
    keys = "\n".join(f"key {i}a" for i in range(10))
    aligned = "\n".join(f"key {i}a    value {i}" for i in range(6)) + "\nother"
    r = C.tabularity(spark.createDataFrame([(1, keys, aligned), (2, "x", None)], "id int, r string, a string"), "id", "r", "a").orderBy("id").collect()
    assert tuple(r[0]) == (1, 10, 6, 0.6, True) and tuple(r[1]) == (2, 1, 0, 0.0, False)


def test_outcomes_in_order(spark):
    import datetime as dt

    rows = [
        (1, "https://bad.co.uk/x", "h1", 0, 500), (2, "https://ok.com/a", "h2", 0, 500), (3, "https://ok.com/a/#z", "h3", 1, 500), (4, "https://ok.com/thin", "h4", 2, 5), (5, "https://ok.com/b", "H2", 3, 500),
        (6, "https://ok.com/no", "h6", 4, 500), (7, None, None, 5, 500), (8, None, None, 6, 500),
    ]
    df = spark.createDataFrame([(i, s, h, dt.datetime(2025, 1, 1 + k), n) for i, s, h, k, n in rows], "clip_id int, source string, source_hash string, captured_at timestamp, n int")
    block = spark.createDataFrame([("# comment",), ("CO.uk",), ("com",)], "domain string")
    declined = spark.createDataFrame([("https://ok.com/NO",)], "u string").select(url_key(F.col("u")).alias("url_key"))
    got = {r["clip_id"]: r["outcome"] for r in C.capture_status(df, block, declined, F.col("n")).collect()}
    assert got == {1: "blocked", 2: "clipped", 3: "duplicate_url", 4: "thin", 5: "duplicate_hash", 6: "declined", 7: "clipped", 8: "clipped"}


def test_duplicate_plan(spark):
    clips = spark.createDataFrame([("a", "H"), ("b", "h"), ("c", "x"), ("d", "x"), ("e", "y"), ("f", "y"), ("g", "z"), ("h", None), ("i", None)], "path string, source_hash string")
    cited = spark.createDataFrame([("a",), ("a",), ("c",), ("d",)], "path string")
    got = {r["path"]: r["action"] for r in C.duplicate_plan(clips, cited).collect()}
    assert got == {"a": "keep", "b": "remove", "c": "refuse_all_cited", "d": "refuse_all_cited", "e": "refuse_none_cited", "f": "refuse_none_cited"}


def test_extractions(spark):
    df = spark.createDataFrame([("k", "b", "word " * 200), ("k", "a", "thin"), ("k", "c", "a ? b " * 200)], "k string, method string, t string")
    assert C.better_extraction(C.fidelity(df, "t"), "k").collect()[0]["method"] == "b"
    pick = lambda t, c, o: spark.range(1).select(C.extraction_choice(F.lit(t), F.lit(c), F.lit(o))).collect()[0][0]
    assert [pick(True, True, "auto"), pick(True, False, "auto"), pick(False, True, "auto"), pick(True, True, "reading-order"), pick(False, False, "table")] == ["table-aware", "table-flattened", None, "reading-order-forced", "error"]
    kind = lambda b, d, h: spark.range(1).select(C.short_extraction(F.lit(b), F.lit(d), F.lit(h))).collect()[0][0]
    told = "considerable description mentioning several distinctive expressions without repeating themselves anywhere"
    assert [kind("w " * 60, "", "<main >"), kind("something entirely different", told, "<div>"), kind("", "", "")] == ["real", "wrong_node", "empty_shell"]


def test_lint(spark):
    df = spark.createDataFrame(
        [("1", "wiki/entities/a.md", "A world class and “legendary, obviously” thing; clearlyish."), ("2", "wiki/concepts/b.md", "Clearly fine. Legendary."), ("3", "wiki/authored/c.md", "legendary clearly"), ("4", "wiki/syntheses/d.md", "It works. However it fails. But see [[x]]. buttery"), ("5", "wiki/entities/e.md", None)],
        "id string, path string, text string",
    )
    assert {tuple(r) for r in lint.style(df, "id", "path", "text").collect()} == {("1", "puffery", "world-class"), ("2", "editorializing", "clearly")}
    assert [tuple(r) for r in lint.connectives(df, "id", "path", "text").collect()] == [("4", "However it fails.")]
    quoted = lint.quotes(spark.createDataFrame([("p", "It says “the first can be found ... never the other part” and “nobody has ever written this down”.")], "page string, text string"), "page", "text")
    bodies = spark.createDataFrame([("s", "and the first can be found here"), ("t", "never the other part of it, long enough for the whole anchor of the search")], "source string, body string")
    evidence = spark.createDataFrame([("p", "s"), ("p", "t")], "page string, source string")
    assert [(r["quote_no"], r["missing"]) for r in lint.unsupported_quotes(quoted, evidence, bodies, "page").collect()] == [(1, 1)]
    assert lint.unsupported_quotes(quoted, evidence.filter("source = 's'"), bodies, "page").count() == 2
    long = lint.quotes(spark.createDataFrame([("p", "“part of it, long enough for the whole anchor of the search”")], "page string, text string"), "page", "text")
    assert [r["source"] for r in lint.resourced_quotes(long, bodies, "page").collect()] == ["t"]


def test_catalogs(spark):
    pages = spark.createDataFrame([("wiki/b.md", "b", "concept", None, 50), ("wiki/a.md", "a", "concept", "stub", 50), ("wiki/c.md", "c", "odd", None, 5), ("raw/x.md", "x", "clip", None, 9)], "path string, name string, type string, status string, words int")
    got = [tuple(r) for r in catalog.catalog(pages).orderBy("place", "path").collect()]
    assert got == [("concept", 4, "wiki/a.md", "- [[a]] (stub)"), ("concept", 4, "wiki/b.md", "- [[b]]"), ("other", 7, "wiki/c.md", "- [[c]]")]
    kinds = pages.withColumn("kind", F.when(F.col("name") == "b", "backlog-item"))
    assert {r["path"] for r in catalog.catalog(kinds).collect()} == {"wiki/a.md", "wiki/c.md"}
    days = spark.createDataFrame([("f", "2026-07-01", None), ("a", None, "2026-05-01"), ("s", "2026-03-01", "2025-01-01"), ("r", "2025-01-01", None), ("n", None, None)], "p string, r string, u string")
    assert {r["p"]: r["bucket"] for r in catalog.freshness(days, "p", "r", "u", "2026-07-15").collect()} == {"f": "fresh", "a": "aging", "s": "stale", "r": "rotten", "n": "rotten"}


def test_backfill_and_citations(spark):
    clips = spark.createDataFrame([("raw/a-1234567.md", "a-1234567", "h1"), ("raw/b.md", "b", None), ("raw/c-1111111.md", "c-1111111", "h3"), ("raw/c-2222222.md", "c-2222222", "h4"), ("raw/d.md", "d", "h5")], "path string, name string, source_hash string")
    cites = spark.createDataFrame([("p", x) for x in ("a", "b", "c", "d", "z", "a-1234567")], "page string, target string")
    got = {r["target"]: (r["class"], r["source_hash"]) for r in repair.hash_backfill(cites, clips, spark.createDataFrame([("p", "h5")], "page string, source_hash string")).collect()}
    assert got == {"a": ("add", "h1"), "a-1234567": ("add", "h1"), "b": ("nohash", None), "c": ("ambiguous", None), "d": ("have", "h5"), "z": ("unresolved", None)}
    broken = spark.createDataFrame([("p", "A title"), ("p", "lost"), ("q", "x"), ("q", "y")], "page string, target string")
    free = spark.createDataFrame([("p", "raw/1.md", "a-title-1234567"), ("p", "raw/2.md", "other"), ("q", "raw/3.md", "w")], "page string, path string, name string")
    assert {tuple(r) for r in repair.citation_repair(broken, free).collect()} == {("p", "A title", "raw/1.md"), ("p", "lost", "raw/2.md")}


def test_titles_and_binaries(spark):
    t = lambda xs: spark.createDataFrame([(x,) for x in xs], "title string")
    got = {tuple(r) for r in repair.title_match(t(["The Long Report", "Twice told", "Annual", "No match at all"]), t(["the long report!", "Twice Told", "twice-told", "Annual review", "Big no match at all here"])).collect()}
    assert got == {("The Long Report", "the long report!"), ("No match at all", "Big no match at all here")}
    plan = repair.binary_plan(
        spark.createDataFrame([("C:\\s\\my_file.pdf",), ("x/new.docx",), ("y/z.zip",)], "path string"), spark.createDataFrame([("raw/m.md", "My file ")], "path string, title string"), spark.createDataFrame([("x/new.docx", "p"), ("x/new.docx", "q")], "path string, page string")
    )
    assert {r["path"][-3:]: (r["action"], r["twin"], r["n_citers"]) for r in plan.collect()} == {"pdf": ("move", "raw/m.md", 0), "ocx": ("extract", None, 2), "zip": ("blocked", None, 0)}


def test_rewriting(spark):
    run = lambda t, f: spark.createDataFrame([(t,)], "t string").select(f(F.col("t"))).collect()[0][0]
    assert run("---\na: 1\n---\nx", lambda c: repair.with_source_hash(c, F.lit("ff"))) == "---\na: 1\nsource-hash: ff\n---\nx"
    assert run("x", lambda c: repair.with_source_hash(c, F.lit("ff"))) == "x"
    assert run("---\ns: [[A]]\n---\n[[A]]", lambda c: repair.repointed(c, F.lit("[[A]]"), F.lit("[[B]]"))) == "---\ns: [[B]]\n---\n[[A]]"
    df = spark.createDataFrame(
        [(1, '---\nsources: ["[[x/A.md]]"]\n---\nb', ["[[A]]", "[[B]]"]), (2, "---\nsources:\n  - [[A]]\nk: 1\n---\nb", ["[[C]]"]), (3, "---\nk: 1\n---\nb", ["[[C]]"]), (4, "no block", ["[[C]]"]), (5, None, None)], "id int, t string, add array<string>"
    )
    got = {r["id"]: r["text"] for r in repair.merge_frontmatter_list(df, "id", "t", "add", "sources").collect()}
    assert got == {1: '---\nsources: ["[[x/A.md]]", "[[B]]"]\n---\nb', 2: '---\nsources:\n  - [[A]]\n  - "[[C]]"\nk: 1\n---\nb', 3: '---\nk: 1\nsources: ["[[C]]"]\n---\nb', 4: "no block"}


def test_dewrap_items_and_slugs(spark):
    targets = spark.createDataFrame([("Long\ntitle",), ("self-\ncontained",), ("un-\nknown",)], "target string")
    names = spark.createDataFrame([("Long Title",), ("Self-contained",), ("other",)], "name string")
    assert {r["target"]: r["chosen"] for r in repair.resolve_dewrap(targets, names).collect()}.keys() == {"Long\ntitle", "self-\ncontained"}
    items = repair.roadmap_items(spark.createDataFrame([(1, "intro\n- **First thing**: more\n  detail\n- First thing\n* Other. Rest")], "id int, t string"), "id", "t").orderBy("item_no").collect()
    assert [(r["title"], r["slug"]) for r in items] == [("First thing", "first-thing"), ("First thing", "first-thing-2"), ("Other", "other")] and items[0]["body"] == "detail"
    slugs = repair.distinct_slugs(spark.createDataFrame([(1, "A?", "abcdefghij"), (2, "A", "1234567890"), (3, "A", "7654321000")], "id int, t string, h string"), "id", "t", "h").orderBy("id").collect()
    assert [r["slug"] for r in slugs] == ["A", "A-1234567", "A-7654321-2"]


def test_bins(spark):
    e = spark.createDataFrame([("p", 1, "raw/a.md"), ("p", 2, "raw/a.md"), ("q", 1, "raw/b.md")], "purge_id string, entry int, from_path string")
    assert {r["bin_path"] for r in bin_paths(e).collect()} == {".recycle/p/raw/a.md", ".recycle/p/raw/a.md-resurrected-1", ".recycle/q/raw/b.md"}
    assert {tuple(r) for r in restore_plan(e, spark.createDataFrame([("raw/b.md",)], "path string")).collect()} == {("raw/a.md", "restore"), ("raw/b.md", "skip")}


def test_web_pages_and_office_files(spark):
    markup = "<html><head><title>A  b</title><meta name='description' content='About'></head><body><nav>Menu</nav><main><h2>Head</h2><p>One &amp; two</p><script>x()</script></main><footer>f</footer></body></html>"
    assert files.extract_html(markup) == ("A b", "About", "## Head\n\nOne & two", 5)
    assert files.extract_html(None) == ("", "", "", 0)
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p><w:r><w:t>World</w:t></w:r></w:p></w:body></w:document>')
    sheet = io.BytesIO()
    n = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(sheet, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{n}"><si><t>k</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{n}"><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row></sheetData></worksheet>')
    df = spark.createDataFrame([("a.docx", bytearray(buf.getvalue())), ("b.xlsx", bytearray(sheet.getvalue())), ("c.docx", bytearray(b"broken")), ("d.bin", bytearray(b""))], "path string, content binary").withColumn("id", F.col("path"))
    got = {r["id"]: (r["text"], bool(r["error"])) for r in files.extract_office(df, "id", "path", "content").collect()}
    assert got == {"a.docx": ("Hello\n\nWorld", False), "b.xlsx": ("| k | 7 |", False), "c.docx": (None, True), "d.bin": (None, True)}


def test_manifests_and_blocklist(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text('{"id": "p1", "topic": "t", "entries": [{"from": "raw/a.md", "source-hash": "H"}, {"from": "raw/b.md"}], "declines": []}')
    (tmp_path / "m" / "b.json").write_text("{broken")
    entries, bad = files.manifests(spark, str(tmp_path / "m"))
    assert [(r["purge_id"], r["entry"], r["from_path"], r["source_hash"]) for r in entries.orderBy("entry").collect()] == [("p1", 0, "raw/a.md", "H"), ("p1", 1, "raw/b.md", None)]
    assert bad.count() == 1
    (tmp_path / "l.txt").write_text("# x\n Bad.com \n\nworse.org\n")
    assert [r["domain"] for r in files.blocklist(spark, str(tmp_path / "l.txt")).collect()] == ["bad.com", "worse.org"]


def test_quotes_are_looked_up_by_fragment_along_the_evidence_walk(spark, small, tmp_path):
    from gleanery.queries import QUERIES

    rows = {
        "wiki_pages": [
            {"page_id": 1, "path": "wiki/concepts/a.md", "sources": ["[[s]]"]},
            {"page_id": 2, "path": "wiki/sources/s.md", "sources": ["[[raw/c]]"]},
        ],
        "chunks": [
            {"chunk_id": 1, "path": "wiki/concepts/a.md", "start_line": 1, "text": "“The first part stands here ... and the last part there.” “The source page says just this” “Nobody has ever said this anywhere”"},
            {"chunk_id": 2, "path": "wiki/sources/s.md", "start_line": 1, "text": "The source page says just this, in short."},
        ],
        "clippings": [{"clip_id": 1, "path": "raw/c.md", "md": "The first part stands here between others, and the last part there, so to say."}],
        "pdf_clips": [],
    }
    for t, some in rows.items():
        schema = spark.read.parquet(f"{small}/{t}.parquet").schema
        kinds = {f.name: f.dataType.simpleString() for f in schema}
        data = [tuple(str(r[c]) if r.get(c) is not None and kinds[c] == "string" else r.get(c) for c in schema.names) for r in some]
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{t}.parquet")
    got = QUERIES["ln_unsupported_quotes"](spark, str(tmp_path)).collect()
    assert [(r["quote"], r["missing"]) for r in got] == [("Nobody has ever said this anywhere", 1)]
