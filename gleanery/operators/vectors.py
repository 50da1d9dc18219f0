"""Vectors of chunks: cosine, pages ranked by the mean of their chunks or by the best one, fusion of rankings, drift, and the
upkeep of an index keyed by content hash.

Means are kept as one running mean per dimension, an aggregate that combines before the shuffle and runs in generated code;
the vectors are never exploded into a row per dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def mean_vector(vector: str, dimension: int) -> Column:
    """Aggregate: the mean of vectors of equal dimension."""
    return F.array(*[F.avg(F.get(F.col(vector), F.lit(i)).cast("double")) for i in range(dimension)])


def usable(df: DataFrame, vector: str, dimension: int) -> DataFrame:
    return df.filter(F.size(vector) == dimension)


def rank_by_mean(chunks: DataFrame, query: list[float], page: str, position: str, vector: str, limit: int = 10) -> DataFrame:
    """``page, score, best_position, n``: pages by the cosine of the query to the mean of their chunks, and where their best
    chunk is (the first of equals). chunks: one row per chunk; repeats count again."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = usable(chunks, vector, len(query)).withColumn("__s", cosine(F.col(vector), q))
    best = F.max_by(position, F.struct("__s", (-F.col(position)).alias("p"))).alias("best_position")
    pages = rows.groupBy(page).agg(mean_vector(vector, len(query)).alias("m"), best, F.count("*").alias("n"))
    return pages.select(page, cosine(F.col("m"), q).alias("score"), "best_position", "n").orderBy(F.desc("score"), page).limit(limit)


def rank_by_best(chunks: DataFrame, query: list[float], page: str, position: str, vector: str, limit: int = 10) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = usable(chunks, vector, len(query)).withColumn("score", cosine(F.col(vector), q))
    best = F.max(F.struct("score", (-F.col(position)).alias("p"))).alias("b")
    return rows.groupBy(page).agg(best).select(page, F.col("b.score").alias("score"), (-F.col("b.p")).alias("best_position")).orderBy(F.desc("score"), page).limit(limit)


def fuse(lists: list[DataFrame], item: str, rank: str = "rank", k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: ``item, fused, first_list, first_rank``; equal sums in the order of first appearance. Only the top
    of each list comes in, so this stays small whatever was ranked."""
    both = None
    for n, ranked in enumerate(lists):
        part = ranked.select(item, F.col(rank).alias("r"), F.lit(n).alias("l"))
        both = part if both is None else both.unionByName(part)
    first = F.min(F.struct("l", "r")).alias("f")
    fused = both.groupBy(item).agg(F.sum(1.0 / (k + F.col("r"))).alias("fused"), first)
    return fused.select(item, "fused", F.col("f.l").alias("first_list"), F.col("f.r").alias("first_rank")).orderBy(F.desc("fused"), "first_list", "first_rank")


def drift(pages: DataFrame, edges: DataFrame, sources: DataFrame, page: str, source: str, vector: str, dimension: int, below: float = 0.5) -> DataFrame:
    """``page, similarity, n_sources, drifted``: each page against the centroid of its sources; pages without any are left out."""
    center = edges.join(usable(sources, vector, dimension), source).groupBy(page).agg(mean_vector(vector, dimension).alias("c"), F.count("*").alias("n_sources"))
    rows = usable(pages, vector, dimension).join(center, page).withColumn("similarity", cosine(F.col(vector), F.col("c")))
    return rows.select(page, "similarity", "n_sources", (F.col("similarity") < below).alias("drifted"))


def manifest_diff(old: DataFrame, new: DataFrame, key: str, stamps: list[str]) -> DataFrame:
    """``key, change``: added, changed (a stamp differs), removed or unchanged."""
    o, n = old.select(key, F.struct(*stamps).alias("o")), new.select(key, F.struct(*stamps).alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o").eqNullSafe(F.col("n")), "unchanged").otherwise("changed")
    return o.join(n, key, "full_outer").select(key, change.alias("change"))


def needed_hashes(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Hashes of chunks that have no vector, once each."""
    return chunks.filter("hash is not null").select("hash").distinct().join(vectors.filter("embedding is not null").select("hash"), "hash", "left_anti")


def repair_paths(chunks: DataFrame, vectors: DataFrame, unchanged: DataFrame) -> DataFrame:
    """Unchanged files that hold chunks without a vector: they must be chunked again."""
    lost = needed_hashes(chunks, vectors)
    return chunks.join(lost, "hash", "left_semi").select("path").distinct().join(unchanged.select("path"), "path", "left_semi")


def stale_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors whose hash no chunk has."""
    return vectors.join(chunks.select("hash"), "hash", "left_anti")


def coverage(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row ``files, chunks, embedded, missing``; missing counts chunks, not hashes."""
    have = vectors.filter("embedding is not null").select("hash", F.lit(1).alias("v")).distinct()
    return chunks.join(have, "hash", "left").agg(
        F.countDistinct("path").alias("files"), F.count("*").alias("chunks"), F.count("v").alias("embedded"), (F.count("*") - F.count("v")).alias("missing")
    )


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` (already cut to a short list) and ``rank`` from 1."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
