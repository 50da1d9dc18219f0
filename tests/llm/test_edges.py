"""Nulls, empty and very long texts, repeated rows, clashing columns: every operator ends with a defined result."""

import datetime as dt

import pytest

from gleanery.llm import boilerplate, encoding, mixing, scanned, spans, splitting, tokens

DAY = dt.datetime(2025, 1, 1)
LONG = {
    "letters": "x" * 300_000, "words": "word " * 60_000, "blank": " " * 300_000, "lines": "line\n" * 60_000, "cjk": "漢字仮名" * 40_000, "accents": "é" * 200_000, "garbled": ("é" * 100_000).encode().decode("latin1"),
    "dots": "." * 200_000, "hyphens": "ab-\n" * 40_000, "digits": "7" * 100_000, "links": "[a](b) " * 20_000,
}
PAGES = "clip_id long, title string, source string, page_count int, md string, loaded_at timestamp, k string, t string, h string, e string, site string, n int, how string, marks array<int>"
DOCS = "doc_id long, text string, d long, t string, h string, start int, g int, part int, ids string, n_tokens long"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, name, "https://a.example/x", 1, text, DAY) for i, (name, text) in enumerate(LONG.items())]
    rows += [(100, None, None, None, None, None), (101, None, None, None, "", DAY), (None, None, None, None, "text \x00 ퟿", None), (102, "t", "not a url", 1, "\n\n\n", DAY)]
    return spark.createDataFrame([(*r, *["clash"] * 5, 1, "x", [1]) for r in rows + rows], PAGES)


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(LONG.values())) + [(100, None), (101, ""), (102, "  "), (None, "null id " * 60), (103, LONG["words"])]
    return spark.createDataFrame([(*r, 5, "clash", "x", 1, 2, 3, "y", 4) for r in rows + rows], DOCS)


def test_pages(pages):
    assert {r["clip_id"] for r in boilerplate.found(pages).collect()} <= {*range(len(LONG)), None}
    assert {r["clip_id"] for r in encoding.found(pages).collect()} >= {list(LONG).index("garbled")}
    rows = scanned.found(pages).collect()
    assert len(rows) == len({tuple(r) for r in rows}) and {r["defect"] for r in rows} <= {"furniture", "broken", "misread"}


def test_long_garbled_words_are_restored_in_pieces(pages):
    row = next(r for r in encoding.repaired(pages).collect() if r["clip_id"] == list(LONG).index("garbled"))
    assert row["restored"].count("é") > 99_000


def test_documents(docs):
    pairs = {tuple(r) for r in spans.shared_pairs(docs).collect()}
    assert pairs == {(1, 103)}
    got = {(r["doc_id"], r["end"] - r["start"]) for r in spans.shared_intervals(docs).collect()}
    assert got == {(1, 300_000), (103, 300_000)}
    path = tokens.rank_file()
    rows = tokens.encode(docs.filter("doc_id in (0, 1, 2, 100, 101, 102)")).collect()
    assert len(rows) == 12 and all(tokens.text_of(r["ids"], path) == ({**dict(enumerate(LONG.values())), 100: "", 101: "", 102: "  "})[r["doc_id"]] for r in rows)


def test_pieces(docs):
    rows = splitting.split_oversized(docs, "doc_id", "text", "d").collect()
    assert {r["doc_id"] for r in rows} == {*range(len(LONG)), 103}
    assert max(r["n_chars"] for r in rows) <= 1800


def test_mix_with_clashing_columns(spark):
    sizes = spark.createDataFrame([(i, "a", 5, 1.0, 2, 3) for i in range(50)] + [(99, None, 5, 1.0, 2, 3), (98, "a", None, 1.0, 2, 3)], "doc_id long, source string, n_tokens long, weight double, tokens long, copy int")
    targets = spark.createDataFrame([("m", "a", 1.0, None, 7)], "mix_id string, source string, target_share double, max_repeats int, n_docs int")
    rows = mixing.select(sizes, mixing.plan(sizes, targets)).collect()
    assert len(rows) == 50 and {r["copies"] for r in rows} == {1}
