"""Problem 3: text garbled by decoding with the wrong character encoding.

Best-first graph search. A state is a word; the operations are "write it in encoding E and read it as encoding D" and
"unescape character references"; states seen are kept in a hash set. The cost of a state is how implausible its characters
are next to each other (by the number of records that hold each pair of characters, counted over the whole table in Spark),
plus a price per operation, less a bonus for every character that a strict UTF-8 reading puts together, since other text
hardly ever forms valid UTF-8. The cheapest state reached is the restored word. All states that can be reached are looked at:
but for the first, every operation makes the word shorter, so the search ends by itself.

A record is affected if it holds U+FFFD (what was there is lost), a word restored by way of UTF-8 into characters that other
records use, or words that one and the same pair of single-byte or two-byte encodings makes clearly more plausible. The last
is judged for the record as a whole; once a pair of encodings is accepted, it restores the record's doubtful words too.

Scale. Pairs are counted as sets per record, summed in the worker and again before the shuffle; the table of pairs has a
fixed number of cells (4 MB), whatever the corpus, so it may be sent to all executors. Restoring is one pass without shuffle.

Null and empty texts are not affected. Redelivered rows of a record count once. Very long texts are handled word by word.
"""

from __future__ import annotations

import codecs
import heapq
import html
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.sources.tables import latest

CELLS = 1 << 20
#: Encodings a text may have been read in wrongly, and those it may really have been in.
READ_AS = ["cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "iso8859_2"]
REAL = ["cp1252", "cp1251", "cp1250", "koi8_r", "mac_roman", "iso8859_2", "cp932", "euc_jp"]
#: Pairs of single-byte or two-byte encodings that are confused in practice; others cost twice as much.
COMMON = {("cp1252", r) for r in ("cp1251", "cp1250", "iso8859_2", "mac_roman", "cp932", "euc_jp")} | {("mac_roman", "cp1252"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251")}
#: Price of an operation and bonus per character put together by UTF-8, in bits.
PRICE, BONUS = 3.0, 9.0
#: Bits that a numeric character reference costs.
ESCAPED = 6.0
#: What a word must gain to count, and a record's words must gain together to be taken as affected by one pair of encodings.
WORD_GAIN, RECORD_GAIN = 4.0, 5.0
#: Words whose pairs of characters are all in more than one record in 2**ODD are not tried with other encodings than UTF-8.
ODD = 4.5
#: A character is known if so many records, and this share of all, hold it beside others.
KNOWN, KNOWN_SHARE = 2, 0.0005

#: A word; very long ones are taken in pieces.
_WORD = regex.compile(r"[^ \t\n\r\f\v]{0,300}?(?:[^\x00-\x7f]|&#?\w{2,8};)[^ \t\n\r\f\v]{0,300}")
_NEAR = regex.compile(r"[^\x00-\x7f]{2}")
_ESCAPE = regex.compile(r"&#(?:[xX][0-9a-fA-F]+|\d+);")
_RUN = regex.compile(r"[^\x00-\x7f]+")


@lru_cache(maxsize=None)
def _writer(name: str) -> dict[int, int]:
    """Characters to bytes; bytes the encoding leaves undefined stand for the control characters of the same number."""
    out = {b: b for b in range(128)}
    for b in range(128, 256):
        try:
            out[ord(bytes([b]).decode(name))] = b
        except UnicodeDecodeError:
            pass
    for b in range(128, 160):
        out.setdefault(b, b)
    return out


def _written(text: str, name: str) -> bytes | None:
    try:
        return codecs.charmap_encode(text, "strict", _writer(name))[0]
    except UnicodeEncodeError:
        return None


@lru_cache(maxsize=None)
def _sequence(name: str) -> regex.Pattern:
    """Two characters that the encoding writes as the beginning of a sequence of UTF-8."""
    chars = {b: chr(c) for c, b in _writer(name).items()}
    first, second = ("".join(regex.escape(chars[b]) for b in bytes_ if b in chars) for bytes_ in (range(0xC2, 0xF5), range(0x80, 0xC0)))
    return re.compile(f"[{first}][{second}]")


def _decoded(raw: bytes, name: str, text: str) -> str | None:
    """``raw`` read in an encoding; of a piece of a long word, characters cut at its ends stay as they are in ``text``."""
    try:
        return raw.decode(name)
    except UnicodeDecodeError as e:
        if len(text) < 200 or e.start < len(raw) - 3 and e.start > 0:
            return None
        a = next((i for i in range(4) if raw[i] & 0xC0 != 0x80), 0) if name == "utf-8" else 0
        b = e.start if e.start >= len(raw) - 3 else len(raw)
        for end in range(b, max(b - 4, a), -1):
            try:
                return text[:a] + raw[a:end].decode(name) + text[len(text) - (len(raw) - end) :]
            except UnicodeDecodeError:
                pass
        return None


def _as_utf8(text: str, name: str) -> tuple[str, int]:
    """Every run of other than ASCII characters read as UTF-8 where that works; how many characters were put together."""
    made = 0

    def read(m: regex.Match) -> str:
        nonlocal made
        raw = _written(m.group(), name)
        if raw is None:
            return m.group()
        new = _decoded(raw, "utf-8", m.group())
        if new is None:
            return m.group()
        made += len(new)
        return new

    return _RUN.sub(read, text), made


def _as_others(text: str, name: str) -> Iterator[tuple[str, str]]:
    """The text written in an encoding and read in others, where both work."""
    raw = _written(text, name)
    if raw is None:
        return
    for real in REAL:
        if real != name and (new := _decoded(raw, real, text)) is not None:
            yield real, new


def pairs_of(text: str) -> set[int]:
    """Cells of the pairs of neighbouring characters of which at least one isn't ASCII, and of each such character itself.
    White space of any kind counts as one character, digits as another."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if not len(codes):
        return set()
    codes = np.where((codes >= 48) & (codes < 58), 48, np.where((codes <= 32), 32, codes))
    codes = np.concatenate([[32], codes, [32]])
    a, b = codes[:-1], codes[1:]
    odd = (a > 127) | (b > 127)
    cells = (a[odd] * 1000003 + b[odd] * 7919 + 12345) % CELLS
    single = np.unique(codes[codes > 127])
    return set(np.unique(np.concatenate([cells, (single * 40503 + 777) % CELLS])).tolist())


class Plausibility:
    """Costs of characters in a word, in bits, from the numbers of records that hold each pair."""

    def __init__(self, counts: np.ndarray, records: int):
        self.n = max(1, records)
        self.bits = (-np.log2((counts + 0.02) / (self.n + 1))).astype(np.float32)
        self.counts = counts
        self.memo: dict[str, tuple[str, tuple, float]] = {}

    def cost(self, word: str) -> float:
        escaped = ESCAPED * len(_ESCAPE.findall(word)) if "&#" in word else 0.0
        if word.isascii():
            return escaped
        codes = [32] + [48 if "0" <= c <= "9" else ord(c) for c in word] + [32]
        bits = self.bits
        return escaped + float(sum(bits[(a * 1000003 + b * 7919 + 12345) % CELLS] for a, b in zip(codes, codes[1:]) if a > 127 or b > 127))

    def oddest(self, word: str) -> float:
        """Bits of the rarest pair of characters in a word."""
        codes = [32] + [48 if "0" <= c <= "9" else ord(c) for c in word] + [32]
        return max((float(self.bits[(a * 1000003 + b * 7919 + 12345) % CELLS]) for a, b in zip(codes, codes[1:]) if a > 127 or b > 127), default=0.0)

    def known(self, c: str) -> bool:
        return c < "\x80" or self.counts[(ord(c) * 40503 + 777) % CELLS] >= max(KNOWN, KNOWN_SHARE * self.n)

    def restored(self, word: str) -> tuple[str, tuple, float]:
        """The cheapest state reached from ``word``, the operations that lead there, and the bits gained. Best first."""
        if (hit := self.memo.get(word)) is not None:
            return hit
        start = self.cost(word)
        best, best_cost, best_path = word, start, ()
        if "&" not in word and not _NEAR.search(word) and self.oddest(word) <= ODD:
            self.memo[word] = best, best_path, 0.0
            return self.memo[word]
        queue, seen, tie = [(start, 0, word, (), 0.0)], {word}, 0
        while queue:
            total, _, state, path, extra = heapq.heappop(queue)
            if total < best_cost - 1e-6 and any(p != "&" for p in path):
                best, best_cost, best_path = state, total, path
            if state.isascii() and "&" not in state:
                continue
            after: list[tuple[str, str, float]] = []
            if "&" in state and (text := html.unescape(state)) != state:
                after.append((text, "&", 1.0))
            if _NEAR.search(state):  # UTF-8 read wrongly leaves two characters side by side at least
                for name in READ_AS:
                    if not _sequence(name).search(state):
                        continue
                    text, made = _as_utf8(state, name)
                    if made and all(map(self.known, text)):
                        after.append((text, f"{name}>utf-8", PRICE - BONUS * made))
                    elif made and len(path) < 2:  # garbled twice
                        after.append((text, f"{name}>utf-8", PRICE))
            if not state.isascii() and (not path or path == ("&",)) and self.oddest(state) > ODD:
                for name in READ_AS:
                    for real, text in _as_others(state, name):
                        if text != state and all(map(self.known, text)):
                            after.append((text, f"{name}>{real}", (2 if (name, real) in COMMON else 4) * PRICE))
            for text, op, price in after:
                if text not in seen:
                    seen.add(text)
                    tie += 1
                    heapq.heappush(queue, (self.cost(text) + extra + price, tie, text, (*path, op), extra + price))
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[word] = found = (best, best_path, start - best_cost)
        return found

    def repair(self, text: str) -> tuple[str, str | None, float]:
        """The text with its garbled words restored; how it was affected (``utf-8``, another pair of encodings, ``lost``, or
        None); the bits gained."""
        if not text or text.isascii() and "&#" not in text:
            return text, None, 0.0
        chosen: dict[str, str] = {}
        how, gained = None, 0.0
        others: dict[str, dict[str, tuple[str, float]]] = {}
        for word in dict.fromkeys(_WORD.findall(text)):
            new, path, gain = self.restored(word)
            if not path:
                continue
            if any(p.endswith("utf-8") for p in path):
                if gain >= WORD_GAIN:
                    chosen[word], how = new, "utf-8"
                    gained += gain
            else:
                others.setdefault(next(p for p in path if p != "&"), {})[word] = (new, gain)
        for op, words in sorted(others.items(), key=lambda x: -sum(g for _, g in x[1].values())):
            total = sum(g for _, g in words.values() if g >= WORD_GAIN)
            if total >= RECORD_GAIN:
                chosen |= {w: new for w, (new, _) in words.items() if w not in chosen}
                how, gained = how or op, gained + total
        if "�" in text:
            how = how or "lost"
        if not chosen:
            return text, how, gained
        return _WORD.sub(lambda m: chosen.get(m.group(), m.group()), text), how, gained


def plausibility(texts: DataFrame, text: str = "md") -> tuple[np.ndarray, int]:
    """Records per cell, over the whole table: one row per cell at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, n = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            for t in batch["t"]:
                n += 1
                cells = pairs_of(t)
                if cells:
                    counts[list(cells)] += 1
        cell = np.flatnonzero(counts)
        yield pd.DataFrame({"cell": np.r_[-1, cell], "n": np.r_[n, counts[cell]]})

    rows = texts.select(F.col(text).alias("t")).filter("t is not null and t <> ''").mapInPandas(run, "cell bigint, n bigint")
    rows = rows.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # CELLS + 1 rows at most
    counts = np.zeros(CELLS, np.float32)
    inner = rows["cell"].to_numpy() >= 0
    counts[rows["cell"].to_numpy()[inner]] = rows["n"].to_numpy()[inner]
    return counts, int(rows["n"].to_numpy()[~inner].sum())


_MODELS: dict[str, Plausibility] = {}


def worker_model(key: str, counts: np.ndarray, n: int) -> Plausibility:
    """One model per worker and ``key``, which names one set of counts, so that words seen before need no new search."""
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Plausibility(counts, n)
    return _MODELS[key]


def repaired(clips: DataFrame, key: str = "clip_id", text: str = "md") -> DataFrame:
    """``(key, how, gained, original, restored)`` of the affected records. restored is null where nothing could be."""
    rows = latest(clips, key).select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null and t <> ''")
    counts, n = plausibility(clips, text)
    shared, name = clips.sparkSession.sparkContext.broadcast(counts), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = worker_model(name, shared.value, n)
        for batch in batches:
            out = []
            for k, t in zip(batch["k"], batch["t"]):
                new, how, gained = model.repair(t)
                if how:
                    out.append((k, how, float(gained), t, new if new != t else None))
            yield pd.DataFrame(out, columns=[key, "how", "gained", "original", "restored"])

    return rows.mapInPandas(run, f"`{key}` bigint, how string, gained double, original string, restored string")


def found(clips: DataFrame) -> DataFrame:
    """``(clip_id)`` of the affected records."""
    return repaired(clips).select("clip_id")
