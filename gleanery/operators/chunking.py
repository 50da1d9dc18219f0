"""Chunks of markdown for an index: cut at headings and paragraphs, packed to a target size, with overlap and a heading path.

A chunk knows its lines (from 1, in the file), the headings above its start, and begins with the page's title and these
headings. Frontmatter belongs to the first chunk only, without its hashes and cut to a budget. Packing is sequential within a
document and independent between documents, so it runs per row in Arrow batches and nothing is shuffled."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET, OVERLAP, OVERSIZE, FRONTMATTER_BUDGET = 1200, 150, 1.5, 1200
_FM = re.compile(r"\A---\r?\n(.*?)\r?\n---(?:\r?\n|\Z)", re.S)
_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*\s*$")


@dataclass
class _Piece:
    """A run of lines that is not cut unless it is too large."""

    text: str
    first: int
    last: int


@dataclass
class _Open:
    """A chunk being filled."""

    path: list[str]
    pieces: list[_Piece] = field(default_factory=list)

    @property
    def size(self) -> int:
        return sum(len(p.text) + 1 for p in self.pieces)


def frontmatter_for_index(block: str, budget: int = FRONTMATTER_BUDGET) -> str:
    """Frontmatter without content hashes (single or lists), cut after the last whole line within the budget."""
    kept, dropping, size = [], False, 0
    for line in block.split("\n"):
        if re.match(r"source-hash(es)?:", line):
            dropping = True
            continue
        if dropping and re.match(r"\s+-|\s*\]", line):
            continue
        dropping = False
        if size + len(line) + 1 > budget:
            break
        kept.append(line.rstrip("\r"))
        size += len(line) + 1
    return "\n".join(kept)


def _hard(piece: _Piece, target: int, overlap: int) -> Iterator[_Piece]:
    step = max(1, target - overlap)
    for a in range(0, max(1, len(piece.text) - overlap), step):
        part = piece.text[a : a + target]
        first = piece.first + piece.text.count("\n", 0, a)
        yield _Piece(part, first, first + part.count("\n"))


def _sections(lines: list[str], first: int) -> Iterator[tuple[list[str], int, list[_Piece]]]:
    """Per section the headings above and with it, the level of its own, and its paragraphs (the heading opens the first)."""
    stack: list[tuple[int, str]] = []
    level, pieces, run, begin, fence = 0, [], [], first, False

    def close(at: int) -> None:
        if any(x.strip() for x in run):
            pieces.append(_Piece("\n".join(run), begin, at))

    for n, line in enumerate(lines, first):
        if line.lstrip().startswith(("```", "~~~")):
            fence = not fence
        m = None if fence else _HEADING.match(line)
        if m:
            close(n - 1)
            if pieces:
                yield [t for _, t in stack], level, pieces
            level = len(m.group(1))
            stack = [x for x in stack if x[0] < level] + [(level, m.group(2))]
            pieces, run, begin = [], [line], n
        elif not line.strip() and not fence:
            close(n - 1)
            run, begin = [], n + 1
        else:
            if not run:
                begin = n
            run.append(line)
    close(first + len(lines) - 1)
    if pieces:
        yield [t for _, t in stack], level, pieces


def chunk_markdown(text: str, title: str, target: int = TARGET, overlap: int = OVERLAP) -> list[tuple[str, int, int, str]]:
    """``(text, start_line, end_line, heading_path)`` of each chunk. Lines are covered without gaps from the first chunk's start."""
    m = _FM.match(text)
    block, rest = (m.group(1), text[m.end() :]) if m else ("", text)
    skipped = text[: len(text) - len(rest)].count("\n")
    lines = [x.rstrip("\r") for x in rest.split("\n")]
    done: list[_Open] = []
    now = _Open([])
    for path, _, pieces in _sections(lines, skipped + 1):
        if now.pieces and now.size >= target * 0.5:
            done.append(now)
            now = _Open(path)
        elif not now.pieces:
            now = _Open(path)
        for piece in pieces:
            parts = list(_hard(piece, target, overlap)) if len(piece.text) > OVERSIZE * target else [piece]
            for part in parts:
                if now.pieces and now.size + len(part.text) > OVERSIZE * target:
                    done.append(now)
                    now = _Open(path)
                now.pieces.append(part)
                if now.size >= target:
                    done.append(now)
                    now = _Open(path)
    if now.pieces:
        done.append(now)
    if not done and block:
        done.append(_Open([], [_Piece("", 1, max(1, skipped))]))
    out: list[tuple[str, int, int, str]] = []
    before = ""
    for n, c in enumerate(done):
        start = 1 if n == 0 and block else c.pieces[0].first
        end = max(c.pieces[-1].last, done[n + 1].pieces[0].first - 1 if n + 1 < len(done) else 0)
        content = "\n\n".join(p.text for p in c.pieces)
        head = " › ".join([title, *c.path]) if title else " › ".join(c.path)
        fm = frontmatter_for_index(block) if n == 0 and block else ""
        tail = before[-overlap:] if n and overlap else ""
        whole = "\n\n".join(x for x in (head, fm, (tail + "\n" + content) if tail else content) if x)
        out.append((whole, start, end, " › ".join(c.path)))
        before = content
    return out


def chunk_documents(df: DataFrame, key: str, title: str, text: str, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """``(key, chunk_no, start_line, end_line, heading_path, hash, chunk)``; null and empty texts give no chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, h, t in zip(batch["k"], batch["h"], batch["t"]):
                for no, (chunk, a, b, path) in enumerate(chunk_markdown(t, h or "", target, overlap)):
                    rows.append((k, no, a, b, path, hashlib.sha256(chunk.encode()).hexdigest(), chunk))
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "start_line", "end_line", "heading_path", "hash", "chunk"])

    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("k"), F.col(title).alias("h"), F.col(text).alias("t")).filter("t is not null and t <> ''")
    return rows.mapInPandas(run, f"`{key}` {kind}, chunk_no int, start_line int, end_line int, heading_path string, hash string, chunk string")
