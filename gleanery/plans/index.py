"""Queries of the vector index and of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import search as S
from gleanery.operators import vectors as X
from gleanery.plans.registry import query
from gleanery.sources.tables import latest, table

DIMENSION = 96

_V = """ch AS (SELECT DISTINCT chunk_id, path, hash, start_line, indexed_at FROM chunks),
v AS (SELECT hash, any_value(embedding)::DOUBLE[] AS e FROM chunk_vectors WHERE len(embedding) = 96 GROUP BY hash),
q AS (SELECT e FROM v ORDER BY hash LIMIT 1),
r AS (SELECT ch.*, v.e, coalesce(CASE WHEN isnan(list_cosine_similarity(v.e, (SELECT e FROM q))) THEN 0 ELSE list_cosine_similarity(v.e, (SELECT e FROM q)) END, 0) AS s FROM ch JOIN v USING (hash))"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks", "chunk_id", "path", "hash", "start_line", "indexed_at").distinct()


def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    """One vector per hash."""
    return table(spark, d, "chunk_vectors", "hash", "embedding").filter(F.size("embedding") == DIMENSION).groupBy("hash").agg(F.first("embedding").alias("embedding"))


def _query_vector(rows: DataFrame, by: str, vector: str) -> list[float]:
    """The vector a user would ask with: here the first one."""
    return [float(x) for x in rows.orderBy(by).limit(1).collect()[0][vector]]


def _placed(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    v = chunk_vectors(spark, d)
    return chunks(spark, d).join(v, "hash"), _query_vector(v, "hash", "embedding")


@query(
    f"""WITH {_V}, m AS (SELECT path, list(a ORDER BY i) AS m FROM (SELECT path, i, avg(x) AS a FROM (SELECT path, unnest(e) AS x, unnest(range(1, 97)) AS i FROM r) GROUP BY path, i) GROUP BY path),
b AS (SELECT path, arg_max(start_line, (s, -start_line)) AS best_position, count(*) AS n FROM r GROUP BY path)
SELECT path, round(c, 6) AS score, best_position, n FROM (SELECT path, CASE WHEN isnan(list_cosine_similarity(m, (SELECT e FROM q))) THEN 0 ELSE list_cosine_similarity(m, (SELECT e FROM q)) END AS c FROM m)
JOIN b USING (path) ORDER BY c DESC, path LIMIT 10"""
)
def vx_page_rank_mean(spark: SparkSession, d: str) -> DataFrame:
    rows, q = _placed(spark, d)
    return X.rank_by_mean(rows, q, "path", "start_line", "embedding").withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_V} SELECT path, round(max(s), 6) AS score, arg_max(start_line, (s, -start_line)) AS best_position FROM r GROUP BY path ORDER BY max(s) DESC, path LIMIT 10"""
)
def vx_page_rank_best_chunk(spark: SparkSession, d: str) -> DataFrame:
    rows, q = _placed(spark, d)
    return X.rank_by_best(rows, q, "path", "start_line", "embedding").withColumn("score", F.round("score", 6))


_E = """eb AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e FROM eb ORDER BY vec_id LIMIT 1),
m AS (SELECT label, list(a ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS a FROM (SELECT label, unnest(e) AS x, unnest(range(1, 65)) AS i FROM eb) GROUP BY label, i) GROUP BY label)"""


@query(f"WITH {_E} SELECT label, round(list_cosine_similarity(m, (SELECT e FROM q)), 6) AS score FROM m ORDER BY list_cosine_similarity(m, (SELECT e FROM q)) DESC, label LIMIT 10")
def vx_label_rank_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    q = _query_vector(rows, "vec_id", "embedding")
    return X.rank_by_mean(rows, q, "label", "vec_id", "embedding").select("label", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_E}, c AS (SELECT label, m FROM m), s AS (SELECT vec_id, label, list_cosine_similarity(e, m) AS sim FROM eb JOIN c USING (label))
SELECT vec_id, round(sim, 6) AS similarity, (SELECT count(*) FROM eb b WHERE b.label = s.label) AS n_sources, sim < 0.5 AS drifted FROM s"""
)
def vx_drift_centroid(spark: SparkSession, d: str) -> DataFrame:
    """Every vector against the centroid of its label's vectors."""
    rows = table(spark, d, "embeddings")
    center = rows.groupBy("label").agg(X.mean_vector("embedding", 64).alias("c"), F.count("*").alias("n_sources"))
    scored = rows.join(center, "label").withColumn("similarity", X.cosine(F.col("embedding"), F.col("c")))
    return scored.select("vec_id", F.round("similarity", 6).alias("similarity"), "n_sources", (F.col("similarity") < 0.5).alias("drifted"))


@query(
    f"""WITH ch AS (SELECT DISTINCT chunk_id, path, hash FROM chunks), have AS (SELECT DISTINCT hash FROM chunk_vectors WHERE embedding IS NOT NULL)
SELECT count(DISTINCT path) AS files, count(*) AS chunks, count(have.hash) AS embedded, count(*) - count(have.hash) AS missing FROM ch LEFT JOIN have USING (hash)"""
)
def vx_index_coverage(spark: SparkSession, d: str) -> DataFrame:
    return X.coverage(chunks(spark, d), table(spark, d, "chunk_vectors", "hash", "embedding"))


_CUT = "2025-06-01"
_LATE = "2026-01-30"
_DIFF = f"""ch AS (SELECT DISTINCT chunk_id, path, hash, indexed_at FROM chunks),
o AS (SELECT path, max(indexed_at) AS at, count(*) AS n FROM ch WHERE indexed_at < TIMESTAMP '{_CUT}' GROUP BY path),
nw AS (SELECT path, max(indexed_at) AS at, count(*) AS n FROM ch WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE loaded_at >= TIMESTAMP '{_LATE}') GROUP BY path),
df AS (SELECT path, CASE WHEN o.at IS NULL THEN 'added' WHEN nw.at IS NULL THEN 'removed' WHEN o.at = nw.at AND o.n = nw.n THEN 'unchanged' ELSE 'changed' END AS change FROM o FULL JOIN nw USING (path))"""


def _diff(spark: SparkSession, d: str) -> DataFrame:
    """The manifest at an earlier time against one without the chunks that were loaded late."""
    ch = chunks(spark, d)
    late = table(spark, d, "chunks", "chunk_id", "loaded_at").filter(F.col("loaded_at") >= F.lit(_LATE).cast("timestamp_ntz")).select("chunk_id").distinct()
    state = lambda df: df.groupBy("path").agg(F.max("indexed_at").alias("at"), F.count("*").alias("n"))
    return X.manifest_diff(state(ch.filter(F.col("indexed_at") < F.lit(_CUT).cast("timestamp_ntz"))), state(ch.join(late, "chunk_id", "left_anti")), "path", ["at", "n"])


@query(f"WITH {_DIFF} SELECT path, change FROM df")
def vx_manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d)


@query("SELECT DISTINCT hash FROM chunks WHERE hash IS NOT NULL AND hash NOT IN (SELECT hash FROM chunk_vectors WHERE embedding IS NOT NULL AND hash IS NOT NULL)")
def vx_needed_hashes(spark: SparkSession, d: str) -> DataFrame:
    return X.needed_hashes(table(spark, d, "chunks", "hash"), table(spark, d, "chunk_vectors", "hash", "embedding"))


@query("SELECT DISTINCT slot, hash FROM chunk_vectors WHERE hash IS NULL OR hash NOT IN (SELECT hash FROM chunks WHERE hash IS NOT NULL)")
def vx_prune(spark: SparkSession, d: str) -> DataFrame:
    return X.stale_vectors(table(spark, d, "chunk_vectors", "slot", "hash").distinct(), table(spark, d, "chunks", "hash").filter("hash is not null").distinct()).select("slot", "hash")


@query(
    f"""WITH {_DIFF} SELECT DISTINCT ch.path FROM ch JOIN df USING (path) WHERE change = 'unchanged' AND hash IS NOT NULL
  AND hash NOT IN (SELECT hash FROM chunk_vectors WHERE embedding IS NOT NULL AND hash IS NOT NULL)"""
)
def vx_repair_paths(spark: SparkSession, d: str) -> DataFrame:
    return X.repair_paths(chunks(spark, d), table(spark, d, "chunk_vectors", "hash", "embedding"), _diff(spark, d).filter("change = 'unchanged'"))


QUESTION = "harbour ledger without any ceremony"


def _bm25_sql() -> str:
    terms = sorted(set(QUESTION.split()))
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    s = " + ".join(f"ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(terms)))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC) AS nth FROM documents) WHERE nth = 1),
w AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM d),
tf AS (SELECT doc_id, len(w) AS n, {tf} FROM w), st AS (SELECT count(*) AS docs, avg(n) AS mean, {df} FROM tf),
bm AS (SELECT doc_id, {s} AS score FROM tf, st WHERE {some} ORDER BY score DESC, doc_id LIMIT 10)"""


@query(f"WITH {_bm25_sql()} SELECT doc_id, round(score, 6) AS score FROM bm")
def vx_bm25(spark: SparkSession, d: str) -> DataFrame:
    docs = latest(table(spark, d, "documents", "doc_id", "text", "loaded_at"), "doc_id")
    return S.bm25(docs, QUESTION, "doc_id", "text").withColumn("score", F.round("score", 6))


_LENGTH = "ln2 AS (SELECT doc_id FROM d ORDER BY coalesce(length(text), 0) DESC, doc_id LIMIT 10)"


@query(
    f"""WITH {_bm25_sql()}, {_LENGTH}, l AS (SELECT doc_id, 0 AS l, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM bm
  UNION ALL SELECT ln2.doc_id, 1, row_number() OVER (ORDER BY coalesce(length(d.text), 0) DESC, ln2.doc_id) FROM ln2 JOIN d USING (doc_id))
SELECT doc_id, round(sum(1.0 / (60 + r)), 9) AS fused, arg_min(l, (l, r)) AS first_list, CAST(arg_min(r, (l, r)) AS INTEGER) AS first_rank FROM l GROUP BY doc_id"""
)
def vx_rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """The lexical ranking fused with a ranking by length."""
    docs = latest(table(spark, d, "documents", "doc_id", "text", "loaded_at"), "doc_id")
    lexical = X.ranked(S.bm25(docs, QUESTION, "doc_id", "text"), F.desc("score"), F.col("doc_id"))
    size = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).orderBy(F.desc("n"), "doc_id").limit(10)
    return X.fuse([lexical, X.ranked(size, F.desc("n"), F.col("doc_id"))], "doc_id").withColumn("fused", F.round("fused", 9))


@query()
def vx_hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Pages by the words of their chunks and by the mean of their vectors, fused."""
    rows, q = _placed(spark, d)
    pages = latest(table(spark, d, "chunks", "chunk_id", "path", "text", "loaded_at"), "chunk_id").select("path", "text")
    return S.search(pages, rows.withColumn("position", F.col("start_line")), QUESTION, q, "path", "text", parted=True)
