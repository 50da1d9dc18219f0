"""Problem 7: token ids of a corpus by a public byte-level BPE.

The vocabulary is a local rank file whose path is a parameter; it is read once per Python worker. Long texts are split
before encoding at places where the pre-tokenising pattern must split anyway (before a single white space between two
letters or digits), so that no text is held in one regex match and the ids equal those of the whole text. Ids travel as
Arrow lists, never as Python objects per token.

Empty, blank and null texts: an empty text has no ids (an empty list), and so has a null text; blank text is encoded as it is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Name of the vocabulary that the queries use, among the files of public_tokenizers.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Longest text, in characters, that is encoded in one call.
WHOLE = 100_000
_SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?=\s[\p{L}\p{N}])|(?<=\p{L})(?=[^\s\p{L}\p{N}'])")


def rank_file(name: str = VOCABULARY) -> str:
    """Path of a vocabulary file of the installed public_tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tiktoken encoding of a rank file, without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, whole: int = WHOLE) -> Iterator[str]:
    """``text`` in parts of about ``whole`` characters, cut only where the pattern splits whatever surrounds it."""
    at = 0
    while len(text) - at > whole:
        cut = _SAFE.search(text, at + whole)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def ids_of(text: str | None, path: str, whole: int = WHOLE) -> np.ndarray:
    """Token ids of one text."""
    if not text:
        return np.empty(0, dtype=np.uint32)
    enc = encoding(path)
    if len(text) <= whole:
        return enc.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([enc.encode_to_numpy(p, disallowed_special=()) for p in parts(text, whole)])


def text_of(ids, path: str) -> str:
    """The text of token ids: raw bytes of all tokens joined, then decoded, as a character may span tokens."""
    enc = encoding(path)
    return b"".join(enc.decode_single_token_bytes(int(i)) for i in ids).decode("utf-8")


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``(key, ids)`` of every row. Rows are not reduced: give one row per key if that is wanted."""
    path = path or rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [ids_of(t, path) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
            values = np.concatenate(arrays).astype(np.int32) if arrays else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[key, "ids"])

    return df.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, f"`{key}` bigint, ids array<int>")


def count(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The columns ``keep`` (longs and strings) and ``n_tokens`` of every row; the text itself goes no further."""
    path = path or rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array([len(ids_of(t, path)) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*keep, "n_tokens"])

    types = dict(df.dtypes)
    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", n_tokens bigint")
