"""Keeping an index up to date: what changed is chunked, what has no vector is embedded, what no chunk has is dropped.

An embedding provider is any function from a list of texts to a list of vectors; it runs on the executors in Arrow batches.
The default is a hashing vectorizer, which needs no model and gives the same vector everywhere."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import chunking
from gleanery.operators.vectors import manifest_diff, needed_hashes, repair_paths
from gleanery.session import stored
from gleanery.sources import sinks

Provider = Callable[[list[str]], list[list[float]]]
_WORDS = re.compile(r"\w+")


def hashed(texts: list[str], dimension: int = 96) -> list[list[float]]:
    """Vectors of word counts over hashed dimensions with hashed signs, at unit length; all zero for a text without words."""
    out = []
    for t in texts:
        v = [0.0] * dimension
        for w in _WORDS.findall(t.lower()):
            h = xxhash.xxh64_intdigest(w)
            v[h % dimension] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        out.append([x / n for x in v] if n else v)
    return out


def embed(df: DataFrame, key: str, text: str, provider: Provider = hashed) -> DataFrame:
    """``key, embedding, error``: a batch that fails is tried again text by text, so that one bad text costs one vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["t"].tolist()
            try:
                rows = [(k, v, None) for k, v in zip(b["k"], provider(texts))]
            except Exception:
                rows = []
                for k, t in zip(b["k"], texts):
                    try:
                        rows.append((k, provider([t])[0], None))
                    except Exception as e:
                        rows.append((k, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=[key, "embedding", "error"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null").mapInPandas(run, f"`{key}` string, embedding array<float>, error string")


def refresh(spark: SparkSession, files: DataFrame, root: str, provider: Provider = hashed) -> dict[str, int]:
    """Brings the index below ``root`` (tables manifest, chunks and vectors) up to ``files`` (``path, title, text, mtime,
    size``) and says how many files changed, how many chunks were embedded or failed, and how many vectors were dropped.

    Only changed files are chunked again, and unchanged ones that lack vectors; only hashes without a vector are embedded; new
    versions are published by a switch. If everything that was needed failed, and that was three texts or more, the old index
    stays and an error is raised."""
    stamps = files.select("path", "mtime", "size")
    old, chunks, vectors = (sinks.published(spark, root, n) for n in ("manifest", "chunks", "vectors"))
    if old is None or chunks is None or vectors is None:
        old = stamps.limit(0)
        chunks = spark.createDataFrame([], "path string, chunk_no int, start_line int, end_line int, heading_path string, hash string, chunk string")
        vectors = spark.createDataFrame([], "hash string, embedding array<float>")
    diff = stored(manifest_diff(old, stamps, "path", ["mtime", "size"]), "diff")
    again = diff.filter("change in ('added', 'changed')").select("path").unionByName(repair_paths(chunks, vectors, diff.filter("change = 'unchanged'"))).distinct()
    fresh = chunking.chunk_documents(files.join(again, "path", "left_semi"), "path", "title", "text")
    gone = again.unionByName(diff.filter("change = 'removed'").select("path"))
    now = stored(chunks.join(gone, "path", "left_anti").unionByName(fresh), "chunks")
    need = needed_hashes(now, vectors)
    texts = now.join(need, "hash", "left_semi").groupBy("hash").agg(F.min("chunk").alias("chunk"))
    made = stored(embed(texts, "hash", "chunk", provider), "made")
    counts = made.agg(F.count("embedding").alias("ok"), F.count("error").alias("bad")).collect()[0]
    if counts["bad"] >= 3 and not counts["ok"]:
        raise RuntimeError(f"all {counts['bad']} texts failed to embed: {made.select('error').first()['error']}")
    kept = vectors.join(now.select("hash").distinct(), "hash", "left_semi")
    dropped = vectors.count() - kept.count()
    sinks.publish(now, root, "chunks")
    sinks.publish(kept.unionByName(made.filter("embedding is not null").select("hash", "embedding")), root, "vectors")
    sinks.publish(stamps, root, "manifest")
    changed = diff.filter("change <> 'unchanged'").count()
    return {"changed": changed, "embedded": counts["ok"], "failed": counts["bad"], "dropped": dropped}
