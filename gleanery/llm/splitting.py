"""Problem 4: splitting oversized texts at natural boundaries.

A recursive separator hierarchy (section, paragraph, sentence, word, character): a piece ends at the last boundary of the
coarsest level that fills it well enough, else the next finer level is tried. Every piece after the first repeats exactly
``overlap`` characters of the one before, so the pieces are spans of the text and joining them without the repeats gives
the text back. Only texts above the limit reach Python; the filter on the length runs in the JVM.

Null, empty and short texts give no pieces. A text without any boundary is cut between characters, never inside a
CR LF pair or between a letter and its combining marks, unless there is no other place in the whole window.
"""

from __future__ import annotations

import bisect
import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

LIMIT = 1800
OVERLAP = 150
#: A coarser boundary is taken only if the piece gets at least this share of the room it has.
MIN_FILL = 0.5

#: Each match ends at a place to cut, coarsest level first.
LEVELS = [
    regex.compile(r"\n(?=#{1,6}[ \t])"),
    regex.compile(r"\r?\n(?:[ \t\r]*\n)+"),
    regex.compile(r"\n|(?<![.!?…])[.!?…]++[\"”»’)\]]*+[ \t\u00a0\r]++|(?<![。！？])[。！？]++[」』）]*+"),
    regex.compile(r"\s++"),
]


def _safe(text: str, at: int) -> bool:
    """Whether a cut before ``text[at]`` leaves CR LF, combining marks, joiners and variation selectors with what they follow."""
    c = text[at]
    if c == "\n" and text[at - 1] == "\r":
        return False
    return not (unicodedata.combining(c) or c in "‍︎️" or text[at - 1] == "‍")


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Start and end of each piece of ``text``; one span if it isn't longer than ``limit``."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    if len(text) <= limit:
        return [(0, len(text))]
    cuts = [[m.end() for m in level.finditer(text)] for level in LEVELS]
    out, start, done = [], 0, 0
    while True:
        if len(text) - start <= limit:
            out.append((start, len(text)))
            return out
        high = start + limit
        least = done + max(1, int((high - done) * MIN_FILL))
        end = 0
        for level in cuts:
            i = bisect.bisect_right(level, high) - 1
            if i >= 0 and level[i] >= least:
                end = level[i]
                break
        if not end:
            end = next((x for x in range(high, done, -1) if _safe(text, x)), high)
        out.append((start, end))
        done, start = end, max(0, end - overlap)


def split_oversized(df: DataFrame, key: str = "chunk_id", text: str = "text", line: str = "start_line", limit: int = LIMIT, overlap: int = OVERLAP, order: str | None = None) -> DataFrame:
    """Pieces of the texts longer than ``limit`` characters:
    ``(key, piece_no, start_line, end_line, start_char, n_chars, hash, piece)``, piece_no from 1.

    Repeated rows (same key and text) give one set of pieces, and so, with ``order``, do rows of one key: of the longer texts
    the one latest in this column counts. A null start line gives null lines. Other columns are ignored."""
    schema = StructType(
        [StructField(key, LongType()), StructField("piece_no", IntegerType()), StructField("start_line", IntegerType()), StructField("end_line", IntegerType())]
        + [StructField("start_char", IntegerType()), StructField("n_chars", IntegerType()), StructField("hash", StringType()), StructField("piece", StringType())]
    )

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t, first in zip(batch["k"], batch["t"], batch["n"]):
                at, newlines = 0, 0
                for no, (a, b) in enumerate(spans(t, limit, overlap), 1):
                    newlines += t.count("\n", at, a)
                    at = a
                    piece = t[a:b]
                    known = not pd.isna(first)
                    last = newlines + piece.count("\n", 0, len(piece) - 1)
                    rows.append((k, no, int(first) + newlines if known else None, int(first) + last if known else None, a, b - a, hashlib.sha256(piece.encode()).hexdigest(), piece))
            out = pd.DataFrame(rows, columns=schema.names)
            yield out.astype({"piece_no": "Int32", "start_line": "Int32", "end_line": "Int32", "start_char": "Int32", "n_chars": "Int32"})

    large = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.col(line).alias("n")).filter(F.length("t") > limit)
    if order:
        # sizes and hashes settle equal times; only oversized texts are shuffled
        rows = df.filter(F.length(text) > limit).select(F.col(key).cast("long").alias("k"), F.struct(F.col(order), F.xxhash64(text), F.col(text).alias("t"), F.col(line).alias("n")).alias("x"))
        large = rows.filter("k is not null").groupBy("k").agg(F.max("x").alias("x")).select("k", "x.t", "x.n").unionByName(rows.filter("k is null").select("k", "x.t", "x.n").dropDuplicates())
        return large.mapInPandas(pieces, schema)
    return large.dropDuplicates().mapInPandas(pieces, schema)
