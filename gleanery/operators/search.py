"""Retrieval: a lexical ranking (BM25), a semantic one, and their fusion, with a fallback to the lexical one alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.vectors import fuse, rank_by_mean, ranked

WORDS = r"[^\p{L}\p{N}]+"


def bm25(docs: DataFrame, query: str, key: str, text: str, limit: int = 10, k1: float = 1.2, b: float = 0.75, parted: bool = False) -> DataFrame:
    """``key, score``: documents by BM25 over lower-case words; equal scores by key. ``parted``: a document may have several rows,
    whose counts are summed; its text is never put together.

    Only counts of the query's words leave the scan: no inverted index is shuffled. Lengths and document frequencies come from
    the same rows in one small aggregate."""
    terms = sorted({w for w in _words(query) if w})
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), WORDS), lambda w: w != "")

    def times(term: str) -> Column:
        return F.size(F.filter("w", lambda w: w == term))

    rows = docs.select(key, words.alias("w")).select(key, F.size("w").alias("n"), *[times(t).alias(f"tf{i}") for i, t in enumerate(terms)])
    if parted:
        rows = rows.groupBy(key).agg(F.sum("n").alias("n"), *[F.sum(f"tf{i}").alias(f"tf{i}") for i in range(len(terms))])
    stats = rows.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    hits = rows.filter(" or ".join(f"tf{i} > 0" for i in range(len(terms)))).join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}").cast("double"), F.col(f"df{i}").cast("double")
        idf = F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return hits.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(limit)


def _words(query: str) -> list[str]:
    import regex

    return regex.split(WORDS, query.lower())


def search(docs: DataFrame, chunks: DataFrame | None, query: str, vector: list[float] | None, key: str, text: str, limit: int = 10, parted: bool = False) -> DataFrame:
    """``key, fused, first_list, first_rank``: both rankings fused, or the lexical one where there are no vectors."""
    lists = [ranked(bm25(docs, query, key, text, limit, parted=parted), F.desc("score"), F.col(key))]
    if chunks is not None and vector is not None:
        near = rank_by_mean(chunks, vector, key, "position", "embedding", limit)
        lists.append(ranked(near, F.desc("score"), F.col(key)))
    return fuse(lists, key)
