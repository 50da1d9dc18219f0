"""Template removal, wrong encodings, scanned text, on small corpora."""

import datetime as dt
import random

import numpy as np
import pytest

from gleanery.llm import boilerplate as B
from gleanery.llm import encoding as E
from gleanery.llm import scanned as S

NOUNS = "harbour ledger viaduct kernel terrace orchard lantern chapter basin sensor meadow furnace bridge gazette parcel treatise".split()
VERBS = "records balances shelters questions returns measures weakens touches follows".split()


def sentence(rng):
    return f"The {rng.choice(['quiet', 'narrow', 'copper', 'long-term'])} {rng.choice(NOUNS)} {rng.choice(VERBS)} {rng.randint(2, 99)} {rng.choice(NOUNS)}s near the {rng.choice(NOUNS)}."


def paragraph(rng, n=6):
    return " ".join(sentence(rng) for _ in range(n))


PAGES = "clip_id long, title string, source string, md string, loaded_at timestamp, e string, site string, marks string"


def pages(spark, rows):
    return spark.createDataFrame([(i, t, s, m, dt.datetime(2025, 1, 1), "x", "y", None) for i, t, s, m in rows], PAGES)


def site_page(rng, i, title):
    article = [f"# {title}", "", sentence(rng), "", "## Findings", "", sentence(rng), "".join(rng.choice("aeioumn") for _ in range(9)).capitalize() + ".", "", "| a | n |", "|---|---|", f"| b | {i} |", "", "```", "Share this", "```"]
    around = ["* Home", "* Press", "* Shop", "", "We use cookies to count visits. See our 12 partners.", "", *article, "", "### Editor picks", f"- [Other {i} thing](/a)", "", "Share this", f"© 20{10 + i % 9} Alpha Press. All rights reserved."]
    wanted = {n for n, line in enumerate(around, 1) if line.strip() and not (7 <= n <= 22)}
    return "\n".join(around), wanted


def test_template_is_removed_and_articles_stay(spark):
    rng = random.Random(1)
    rows, expected = [], set()
    for i in range(30):
        md, wanted = site_page(rng, i, f"Title {i} of things")
        rows.append((i, f"Title {i} of things", ["https://www.alpha.example/a", "HTTP://ALPHA.example:80/b", "https://m.alpha.example/"][i % 3], md))
        expected |= {(i, n) for n in wanted}
    rows += [(100, None, None, None), (101, "x", "https://alpha.example", ""), (102, "Only", "https://other.example/x", "# Only\r\n\r\n" + sentence(rng))]
    got = {tuple(r) for r in B.found(pages(spark, rows)).collect()}
    assert got == expected
    article = {r["clip_id"]: r["article"] for r in B.articles(pages(spark, rows)).collect()}
    assert article[0].startswith("# Title 0 of things") and "cookies" not in article[0] and "Share this" in article[0]


def test_template_of_an_empty_table(spark):
    assert B.found(pages(spark, [])).count() == 0


WORDS = "Straße größer öffnet für über Brücke Prüfung schützt Gewässer Häfen café déjà été naïve Größe “quoted” don’t".split()
CYRILLIC = "крепость описывает ключи мельница измеряет остатки тетрадь лестница проверка записи".split()


def clean_text(rng, words):
    return "\n".join(" ".join(rng.choice(words + ["plain", "words", "stand", "here"]) for _ in range(9)) for _ in range(6))


PDFS = "clip_id long, title string, page_count int, md string, loaded_at timestamp, how string, restored string"


def pdfs(spark, rows):
    return spark.createDataFrame([(i, t, 1, m, dt.datetime(2025, 1, 1), None, None) for i, t, m in rows], PDFS)


def test_wrong_encodings_are_found_and_undone(spark):
    rng = random.Random(2)
    rows, garbled = [], {}
    for i in range(120):
        rows.append((i, "t", clean_text(rng, WORDS if i % 2 else CYRILLIC)))
    damage = {
        "latin": lambda t: t.encode().decode("cp1252", "ignore"), "dos": lambda t: t.encode().decode("cp437"), "mac": lambda t: t.encode().decode("mac_roman"),
        "twice": lambda t: t.encode().decode("latin1").encode().decode("latin1"),
        "entities": lambda t: "".join(c if c < "\x80" else f"&#{ord(c)};" for c in t.encode().decode("latin1")),
    }
    for n, (name, f) in enumerate(damage.items()):
        words = [w for w in WORDS if name != "latin" or not set(w) & set("“”’")]
        text = clean_text(rng, words)
        lines = text.split("\n")
        rows.append((1000 + n, "t", "\n".join(f(x) if k % 2 else x for k, x in enumerate(lines))))
        garbled[1000 + n] = text
    text = clean_text(rng, CYRILLIC)
    rows.append((2000, "t", text.encode("koi8_r").decode("cp1251")))
    garbled[2000] = text
    rows += [(3000, "t", "lost � here"), (3001, "t", None), (3002, "t", ""), (3003, "t", "A IRMÃ “x” NÃO ÂGE DE"), (3004, "t", "plain &amp; simple")]
    out = {r["clip_id"]: r for r in E.repaired(pdfs(spark, rows + rows[:3])).collect()}
    assert set(out) == set(garbled) | {3000}
    assert out[3000]["how"] == "lost" and out[3000]["restored"] is None
    for k, text in garbled.items():
        same = sum(a == b for a, b in zip(text.split(), out[k]["restored"].split())) / len(text.split())
        assert same > 0.9, (k, same)


def test_encoding_of_an_empty_table(spark):
    assert E.found(pdfs(spark, [])).count() == 0


def wrapped(rng, text, width=60):
    """Lines of a width, words divided at the end of some; indices of the divided lines."""
    lines, line, cut = [], "", set()
    for w in text.split():
        if len(line) + len(w) + 1 > width and line:
            room = width - len(line) - 2
            if w.isalpha() and len(w) >= 6 and 2 <= room <= len(w) - 2 and rng.random() < 0.8:
                lines.append(line + " " + w[:room] + rng.choice("-¬‐"))
                cut.add(len(lines) - 1)
                w = w[room:]
            else:
                lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return lines + [line], cut


@pytest.fixture(scope="module")
def scanned(spark):
    rng = random.Random(4)
    rows, truth = [], set()
    for i in range(150):
        lines, cut = wrapped(rng, paragraph(rng, 14))
        wrong = set()
        for k, line in enumerate(lines):
            known = [w for w in line.split() if w.isalpha() and w in NOUNS]
            if k not in cut and k - 1 not in cut and rng.random() < 0.15 and known:
                word, (x, y) = rng.choice(known), rng.choice([("e", "c"), ("r", "rr"), ("a", "o"), ("e", "")])
                if x in word:  # recognition that is told from the corpus: replaced, put in, left out
                    lines[k] = line.replace(word, word.replace(x, y, 1), 1)
                    wrong.add(k)
        if i % 3 == 0:
            number = 40 + i
            pages, at = [], {}
            for k, line in enumerate(lines):
                if k and k % 6 == 0:
                    pages += [f"— {number} —", f"\fTitle of {i}"]
                    truth |= {(i, len(pages) - 1, "furniture"), (i, len(pages), "furniture")}
                    number += 1
                at[k] = len(pages)
                pages.append(line)
            lines, cut, wrong = pages, {at[k] for k in cut}, {at[k] for k in wrong}
        truth |= {(i, k + 1, "broken") for k in cut} | {(i, k + 1, "misread") for k in wrong}
        rows.append((i, f"Title of {i}", "\n".join(lines)))
    rows += [(900, None, None), (901, "t", ""), (902, "t", "x")]
    return rows, truth, {tuple(r) for r in S.found(pdfs(spark, rows)).collect()}


@pytest.mark.parametrize("defect", ["furniture", "broken", "misread"])
def test_defects_on_held_out_noise(scanned, defect):
    _, truth, got = scanned
    want, have = {x for x in truth if x[2] == defect}, {x for x in got if x[2] == defect}
    assert len(want) > 5
    assert len(want & have) >= 0.95 * len(want) and len(want & have) >= 0.95 * len(have)


def test_an_untrained_model_finds_nothing():
    editor = S.Editor(S.Counts(np.full(1 << 12, 40, np.uint8)), {("c", "e"): 9, ("", "e"): 9, ("1", ""): 9})
    text = "A lcdger of the led-\nger 1\n\n- 5 -\nTitle\n\nand so on\n\n- 6 -\nTitle"
    assert S.defects(text, "Title", editor)[0] == {}


def test_edits_are_learned_from_words():
    common = {w: 50 for w in "harbour ledger kernel terrace lantern chapter sensor meadow furnace bridge gazette parcel treatise".split()}
    rare = {w.replace("e", "c", 1): 1 for w in common} | {w.replace("rn", "m"): 1 for w in common} | {w + "s": 1 for w in list(common)[:3]}
    edits = S.learn_edits(common, {w: n for w, n in rare.items() if w not in common})
    assert ("c", "e") in edits and ("s", "") not in edits
    editor = S.train(S.Counts(cells(common)), edits, list(common), [], [])
    assert editor.correct("tcrrace") == "terrace" and editor.correct("terrace") == "terrace" and editor.correct("zwcig") == "zwcig"


def cells(words):
    out = np.zeros(1 << 16, np.uint8)
    for w, n in words.items():
        for place in S.Counts.places(w, len(out)):
            out[place] = S._step(np.array([n]))[0]
    return out


def test_long_words_and_many_equal_lines_end(spark):
    rows = [(1, "t", "x" * 300_000), (2, "t", "line\n" * 30_000), (3, "t", "ab-\n" * 20_000), (4, "t", "7\n" * 20_000), (5, "t", "é" * 100_000)]
    assert {r["defect"] for r in S.found(pdfs(spark, rows)).collect()} <= {"furniture", "broken", "misread"}


def test_paragraphs_are_continuous():
    lines = ["The copper led-", "— 5 —", "ger is long-", "term here.", "", "## Head", "", "Next"]
    assert S.paragraphs(lines, {1}, {0}) == "The copper ledger is long-term here.\n\n## Head\n\nNext"


def test_scanned_of_an_empty_table(spark):
    assert S.found(pdfs(spark, [])).count() == 0


def test_nothing_is_deleted_that_does_not_recur():
    """With no element recurring no line goes, whatever its form; with all recurring all but the title goes."""
    rng = random.Random(9)
    for i in range(20):
        md, _ = site_page(rng, i, f"Title {i} of things")
        md += "\n\n- Brown flour\n- Salt\n\nRoses are red,\nviolets too\n\n> Quoted\n\n[a](b) | [c](d)\nNext: Other"
        code, hashes = B.parse(md, "alpha.example", f"Title {i} of things")
        codes = memoryview(code).cast("i").tolist()
        assert B.judge(codes, [False] * len(hashes)) == []
        lines = md.split("\n")
        kept = [x for n, x in enumerate(lines, 1) if x.strip() and n not in B.judge(codes, [True] * len(hashes))]
        assert kept[0] == f"# Title {i} of things"


def test_subtrees_are_deleted_by_recurrence(spark):
    rows, expected = [], set()
    for i in range(12):
        table = "| Open | Closed |\n|---|---|\n| Mon | Sun |"
        recipe = "".join(chr(97 + (i * 7 + k * k) % 26) for k in range(8)).capitalize()
        md = f"Menu\n- Home\n- Shop\n{table}\nFooter line\n\n# T{i}\n\n- {recipe} flour\n- {recipe} salt\n\nIt was {recipe} that did it.\n\n{table}\n\nThen {recipe} went on.\n\nMore to read\n- The {recipe} story\n- A {recipe} tale"
        rows.append((i, f"T{i}", "https://beta.example/x", md))
        lines = md.split("\n")
        expected |= {(i, n) for n in [*range(1, 8), *range(len(lines) - 2, len(lines) + 1)] if lines[n - 1].strip()}
    got = {tuple(r) for r in B.found(pages(spark, rows)).collect()}
    assert got == expected


@pytest.mark.parametrize("few", [0, 10**6])
def test_elements_over_sites_come_back_whole_by_broadcast_or_join(spark, few, monkeypatch):
    """Sites of one page each are told by what recurs over sites; a page of many parts and names has no limit."""
    monkeypatch.setattr(B, "FEW", few)
    monkeypatch.setattr(B, "SALTED", 2)
    rng = random.Random(5)
    menu = " | ".join(f"Part{chr(97 + k)}" for k in range(26)) + " | " + " | ".join(f"More{chr(97 + k)}" for k in range(26))
    rows = [(i, None, f"https://only{i}.example/", f"{menu}\n\n{sentence(rng)} {i} {'ab'[i % 2] * i}.") for i in range(9)]
    assert {tuple(r) for r in B.found(pages(spark, rows)).collect()} == {(i, 1) for i in range(9)}


def counted(spark, words):
    return spark.createDataFrame([(w, n, n) for w, n in words.items()], "w string, n bigint, plain bigint")


def test_no_word_is_left_out_of_the_counts(spark, monkeypatch):
    """A table with far fewer cells than words loses none of them and makes up none."""
    monkeypatch.setattr(S, "CELLS", 1 << 10)
    texts = spark.createDataFrame([(f"of{chr(97 + i % 26)}{i} all of{i}x", False) for i in range(3000)], "t string, odd boolean")
    counts, words = S.word_counts(texts)
    assert words.count() == 6001 and len(counts.cells) == 1 << 10
    assert {counts(f"of{i}x") for i in range(3000)} == {0.0} and abs(counts("all") - np.log2(3000)) < 0.1
    assert {counts(f"not{i}") for i in range(3000)} == {-1.0}
    again = spark.range(8).repartition(2).rdd.map(lambda r: counts(f"of{r[0]}x")).collect()
    assert again == [0.0] * 8


def test_counts_in_many_parts(spark):
    words = spark.range(150_000).selectExpr("concat('w', id) AS w", "id % 7 + 1 AS n")
    counts = S._listed(words)
    assert len(counts.words[3]) > 1 and sum(e - b for b, e in zip(*counts.words[3:])) == 150_000
    assert all(abs(counts(f"w{i}") - np.log2(i % 7 + 1)) < 0.1 for i in range(0, 150_000, 7919)) and counts("w150000") == -1


def vocabulary(rng, n):
    out = set()
    while len(out) < n:
        out.add("".join(rng.choice("bdfgklmprstvz") + rng.choice("aeiou") for _ in range(4)))
    return sorted(out)


def test_edits_are_learned_from_all_words(spark):
    """Of words behind the 2,000 most frequent, with more rare words than a sample of 6,000 would show often enough."""
    rng = random.Random(8)
    words = vocabulary(rng, 2600)
    common = {w: 5000 - i for i, w in enumerate(words[:2500])} | {w[:3] + "q" + w[4:]: 50 for w in words[2500:]}
    rare = {w.replace("q", "9"): 2 for w in common if "q" in w} | {"".join(rng.choice("hjwxy") for _ in range(9)): 1 for _ in range(9000)}
    edits = S.edits_of(counted(spark, common | rare))
    assert edits == S.learn_edits(common, rare) and edits == {("9", "q"): sum("q" in w for w in common)}


def test_edits_over_tables_are_those_of_the_words_themselves(spark):
    rng = random.Random(3)
    common = {w: rng.choice([5, 8, 20, 60, 300]) for w in vocabulary(rng, 300)}
    rare = {}
    for w in common:
        for x, y in (("a", "o"), ("e", ""), ("", "l"), ("k", "lc"), ("ro", "n"), ("i", "ii")):
            if x in w and rng.random() < 0.5:
                rare[w.replace(x, y, 1)] = 1
    rare = {w: n for w, n in rare.items() if w not in common}
    edits = S.edits_of(counted(spark, common | rare))
    assert len(edits) > 4 and edits == S.learn_edits(common, common | rare)


def test_a_rare_word_near_many_frequent_ones_is_aligned():
    stems = "harb ledg viad kern terr orch".split()
    common = {s + v: n for s in stems for v, n in (("er", 900), ("or", 50), ("ar", 50), ("ur", 50))}
    assert S.learn_edits(common, {s + "cr": 1 for s in stems}) == {("c", "e"): 6}


def test_frequent_words_behind_the_first_are_trained_on(spark, monkeypatch):
    """Only the least frequent words have letters that are misread: their features have weights nevertheless, and compounds hold."""
    monkeypatch.setattr(S, "TRAIN_WORDS", 100)
    words = {w: 500 for w in vocabulary(random.Random(2), 300)} | {f"{w[:4]}qu{w[6:]}": 20 for w in vocabulary(random.Random(3), 60)} | {"long-term": 60, "hand-built": 60, "long": 90, "term": 90}
    counts, edits = S._listed(counted(spark, words)), {("9", "q"): 60}
    weights = {r["k"]: r["v"] for r in S._words_fitted(counted(spark, words), spark.sparkContext.broadcast(counts), edits).groupBy("k").sum("v").toDF("k", "v").collect()}
    model = S.Perceptron()
    model.w.update(weights)
    editor = S.Editor(counts, edits, model)
    misread = [w for w in words if "q" in w]
    assert sum(editor.correct(w.replace("q", "9")) == w for w in misread) > 55 and all(editor.correct(w) == w for w in words)
    assert not editor.joins("long", "-", "term") and editor.joins(misread[0][:4], "-", misread[0][4:])
