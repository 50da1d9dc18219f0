"""Splitting, token ids, mixing."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm import mixing as M
from gleanery.llm import splitting as P
from gleanery.llm import tokens as T

PIECES = st.lists(st.sampled_from(["word ", "Sentence ends. ", "\n\n", "\n# Head\n", "漢字。", "é", "\r\n", "x" * 37, "👩‍👩‍👧", "\t"]), max_size=120).map("".join)


@settings(max_examples=150, deadline=None)
@given(PIECES, st.integers(10, 90), st.integers(0, 9))
def test_spans_cover_with_exact_overlap(text, limit, overlap):
    got = P.spans(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text) and all(0 <= b - a <= limit for a, b in got)
    for (a, b), (c, d) in zip(got, got[1:]):
        assert c == max(0, b - overlap) and d > b
    assert "".join(text[max(a, e):b] for (a, b), e in zip(got, [0] + [b for _, b in got])) == text


def test_cuts_at_natural_boundaries():
    text = "# A\n" + "one two. " * 60 + "\n\n" + "three four. " * 60 + "\n# B\n" + "five six. " * 40
    for a, b in P.spans(text, 600, 50)[:-1]:
        assert text[b - 1] in " \n"
    assert any(text[b:].startswith("# B") for _, b in P.spans(text, 900, 50))


def test_no_cut_inside_a_line_end_or_before_a_mark():
    for a, b in P.spans("x" * 9 + "\r\n" * 30, 10, 0)[:-1]:
        assert b != 10
    assert all(b % 2 == 0 for _, b in P.spans("é" * 50, 11, 0)[:-1])


def test_split_oversized(spark):
    long = "\n".join(f"line {i}." for i in range(400))
    rows = [(1, long, 10, "h"), (1, long, 10, "h"), (2, "short", 1, "h"), (3, None, 1, "h"), (4, "y" * 1801, None, "h"), (5, "z" * 1800, 1, "h")]
    got = P.split_oversized(spark.createDataFrame(rows, "chunk_id long, text string, start_line int, hash string")).orderBy("chunk_id", "piece_no").collect()
    assert {r["chunk_id"] for r in got} == {1, 4}
    one = [r for r in got if r["chunk_id"] == 1]
    assert [r["piece_no"] for r in one] == list(range(1, len(one) + 1)) and one[0]["start_line"] == 10
    for a, b in zip(one, one[1:]):
        assert b["piece"].startswith(a["piece"][-150:]) and b["start_line"] == 10 + long[: b["start_char"]].count("\n")
    assert all(r["hash"] == hashlib.sha256(r["piece"].encode()).hexdigest() and r["n_chars"] == len(r["piece"]) <= 1800 for r in got)
    assert [r["start_line"] for r in got if r["chunk_id"] == 4] == [None, None]


def test_ids_equal_another_library_and_come_back(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    texts = ["Hello, world!", "", " \n\t ", "<|endoftext|>", "naïve 漢字 👩‍👩‍👧 ", "a" * 3000, "it's we'll\r\n\r\n  x", None]
    rows = {r["doc_id"]: r["ids"] for r in T.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    path = T.rank_file()
    for i, t in enumerate(texts):
        assert rows[i] == (other.encode(t, add_special_tokens=False).ids if t else [])
        assert T.text_of(rows[i], path) == (t or "")
    assert T.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_are_cut_without_trace():
    rng = random.Random(3)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "12", "'s", "é", "漢", "!", "\t", " a"]) for _ in range(4000))
    path = T.rank_file()
    assert len(list(T.parts(text, 300))) > 5 and "".join(T.parts(text, 300)) == text
    assert T.ids_of(text, path, 300).tolist() == T.ids_of(text, path).tolist()


def test_long_texts_without_blanks_are_cut_at_punctuation():
    rng = random.Random(4)
    text = "".join(rng.choice(["漢字", "仮名", "。", "、", "'s", "abc", "9", "''", "!?"]) for _ in range(4000))
    path = T.rank_file()
    assert max(map(len, T.parts(text, 300))) < 600
    assert T.ids_of(text, path, 300).tolist() == T.ids_of(text, path).tolist()


SIZES, TARGETS = "doc_id long, source string, n_tokens long", "mix_id string, source string, target_share double, max_repeats int"


def mixed(spark, sizes, targets, budget=None):
    s, t = spark.createDataFrame(sizes, SIZES), spark.createDataFrame(targets, TARGETS)
    planned = M.plan(s, t, budget)
    chosen = M.select(s, planned)
    return {(r["mix_id"], r["source"]): r for r in M.shares(chosen, planned).collect()}, chosen.collect()


def test_shares_meet_targets_and_repeats_are_capped(spark):
    sizes = [(i, "a", 10) for i in range(2000)] + [(10_000 + i, "b", 7) for i in range(300)] + [(20_000, "n", 0)]
    shares, chosen = mixed(spark, sizes, [("m", "a", 0.6, 1), ("m", "b", 0.4, 3), ("m", "none", 0.2, 5), ("x", "b", 1.0, 2), ("x", "b", 1.0, 2)])
    assert abs(shares["m", "a"]["actual_share"] - 0.6) < 0.01 and abs(shares["m", "b"]["actual_share"] - 0.4) < 0.01
    assert shares["m", "none"]["taken_tokens"] == 0 and shares["m", "b"]["most_copies"] == 3
    assert shares["x", "b"]["taken_tokens"] == 2 * 2100
    copies = [r["copies"] for r in chosen if r["mix_id"] == "m" and r["source"] == "b"]
    assert max(copies) - min(copies) <= 1  # a round ends before the next begins


def test_a_larger_budget_takes_more_of_what_is_left(spark):
    sizes = [(i, "a", 10) for i in range(100)] + [(1000 + i, "b", 10) for i in range(10)]
    shares, _ = mixed(spark, sizes, [("m", "a", 0.5, 1), ("m", "b", 0.5, 2)], budget=900)
    assert shares["m", "b"]["taken_tokens"] == 200 and shares["m", "b"]["used_up"] and shares["m", "a"]["taken_tokens"] == 700
    shares, _ = mixed(spark, sizes, [("m", "a", 0.5, 1), ("m", "b", 0.5, 2)], budget=10**6)
    assert shares["m", "a"]["taken_tokens"] == 1000 and shares["m", "b"]["taken_tokens"] == 200


def test_a_budget_of_all_documents_uses_small_sources_up(spark):
    sizes = spark.createDataFrame([(i, "a", 10) for i in range(100)] + [(1000 + i, "b", 10) for i in range(10)], SIZES)
    targets = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.5, 3)], TARGETS)
    planned = M.plan(sizes, targets, "all")
    got = {r["source"]: r for r in M.shares(M.select(sizes, planned), planned).collect()}
    assert got["a"]["budget"] == 1100 and got["b"]["used_up"] and got["b"]["most_copies"] == 3 and got["b"]["taken_tokens"] == 300
    assert got["a"]["taken_tokens"] == 800 and got["b"]["actual_share"] < got["b"]["target_share"]


def test_the_latest_of_two_oversized_texts_is_split(spark):
    rows = [(1, "a " * 1000, 1, 1), (1, "b " * 1200, 1, 2), (1, "b " * 1200, 1, 2), (2, "c " * 1000, 1, None), (None, "d " * 1000, 1, 1)]
    got = P.split_oversized(spark.createDataFrame(rows, "chunk_id long, text string, start_line int, loaded_at int"), order="loaded_at").collect()
    assert {(r["chunk_id"], r["piece"][0]) for r in got if r["piece_no"] == 1} == {(1, "b"), (2, "c"), (None, "d")}


@pytest.mark.parametrize("sizes, targets", [([], [("m", "a", 1.0, 1)]), ([(1, "a", 5)], []), ([(1, "a", 5)], [("m", "a", None, 1), ("m", None, 0.5, 1), ("n", "a", 0.0, 1), ("o", "a", 0.5, 0)])])
def test_nothing_to_select(spark, sizes, targets):
    assert mixed(spark, sizes, targets)[1] == []
