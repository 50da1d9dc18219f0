"""The queries of the operators over text and vectors, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import boilerplate, encoding, mixing, neighbours, scanned, spans, splitting, tokens
from gleanery.sources.tables import latest, table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clippings", "clip_id", "title", "source", "loaded_at", "md")


def _pdfs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pdf_clips", "clip_id", "title", "page_count", "loaded_at", "md")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.found(_pages(spark, d))


def p1_articles(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.articles(_pages(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.found(_pdfs(spark, d))


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repaired(_pdfs(spark, d)).select("clip_id", "how", "restored")


def _oversized(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks", "chunk_id", "start_line", "text", "loaded_at")
    return splitting.split_oversized(rows, order="loaded_at")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _oversized(spark, d).filter("piece_no = 2").select("chunk_id").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _oversized(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "chunk_vectors", "slot", "embedding"))


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "chunk_vectors", "slot", "hash", "embedding")
    near = neighbours.nearest(vectors.drop("hash"), curves=12, window=2048)
    return neighbours.with_chunks(near, vectors.drop("embedding"), table(spark, d, "chunks", "chunk_id", "hash"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scanned.found(_pdfs(spark, d))


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    return scanned.cleaned(_pdfs(spark, d)).select("clip_id", "clean")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(latest(table(spark, d, "documents", "doc_id", "text", "loaded_at"), "doc_id"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "source", "text", "loaded_at")
    counted = tokens.count(rows.withColumn("at", F.col("loaded_at").cast("string")), ["doc_id", "source", "at"])
    return counted.groupBy("doc_id").agg(F.max(F.struct("at", "source", "n_tokens")).alias("last")).select("doc_id", "last.source", "last.n_tokens").filter("source is not null")


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    from gleanery.session import stored

    sizes = stored(_sizes(spark, d), "sizes")
    return mixing.select(sizes, mixing.plan(sizes, table(spark, d, "mix_targets")))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    from gleanery.session import stored

    sizes = stored(_sizes(spark, d), "sizes")
    planned = mixing.plan(sizes, table(spark, d, "mix_targets"))
    return mixing.shares(mixing.select(sizes, planned), planned)


def p8_full_shares(spark: SparkSession, d: str) -> DataFrame:
    """Each mix at the size of all documents of its sources: small sources are used up and shares fall behind."""
    from gleanery.session import stored

    sizes = stored(_sizes(spark, d), "sizes")
    planned = mixing.plan(sizes, table(spark, d, "mix_targets"), "all")
    return mixing.shares(mixing.select(sizes, planned), planned)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(_documents(spark, d))


def p9_links(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_links(_documents(spark, d))


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    found = spans.shared_intervals(_documents(spark, d))
    return found.select("doc_id", F.col("start").alias("start_char"), F.col("end").alias("end_char"))


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    documents = _documents(spark, d)
    return spans.shared_report(documents, spans.shared_intervals(documents))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_articles, p3_found, p3_restored, p4_found, p4_pieces, p5_found, p5_neighbours, p6_found, p6_clean,
        p7_ids, p8_selection, p8_shares, p8_full_shares, p9_found, p9_links, p9_spans, p9_shared,
    )
}

#: All windows of 200 characters, those in more than one document, and the pairs of documents that hold them.
_WINDOWS = """d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 200),
w AS (SELECT doc_id, i, substring(text, CAST(i AS INTEGER) + 1, 200) AS w FROM (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS i FROM d)),
r AS (SELECT w FROM w GROUP BY w HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT w.doc_id, w.i, w.w FROM w JOIN r ON w.w = r.w)"""
_PAIRS = "holds AS (SELECT DISTINCT doc_id, w FROM hit), pairs AS (SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM holds a JOIN holds b ON a.w = b.w WHERE a.doc_id < b.doc_id)"
_SPANS = """step AS (SELECT DISTINCT doc_id, i FROM hit),
mark AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM step),
isle AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM mark),
spans AS (SELECT doc_id, min(i) AS start_char, max(i) + 200 AS end_char FROM isle GROUP BY doc_id, g)"""

SQL: dict[str, str] = {
    "p9_found": f"WITH {_WINDOWS}, {_PAIRS} SELECT doc_id_a, doc_id_b FROM pairs",
    "p9_spans": f"WITH {_WINDOWS}, {_SPANS} SELECT doc_id, start_char, end_char FROM spans",
    "p9_shared": f"""WITH {_WINDOWS}, {_SPANS}, n AS (SELECT doc_id, CAST(max(coalesce(length(text), 0)) AS INTEGER) AS n_chars FROM documents GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(end_char - start_char) AS BIGINT) AS shared_chars FROM spans GROUP BY doc_id)
SELECT doc_id, n_chars, coalesce(n_spans, 0) AS n_spans, coalesce(shared_chars, 0) AS shared_chars, CASE WHEN n_chars > 0 THEN coalesce(shared_chars, 0) / n_chars ELSE 0.0 END AS shared_part FROM n LEFT JOIN t USING (doc_id)""",
    "p9_links": f"""WITH {_WINDOWS}, {_PAIRS}, texts AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id FROM texts),
both_ AS (SELECT doc_id_a AS doc_id FROM pairs UNION ALL SELECT doc_id_b FROM pairs), n AS (SELECT doc_id, count(*) AS n FROM both_ GROUP BY doc_id)
SELECT c.doc_id, class_id, coalesce(n, 0) AS n_links FROM c LEFT JOIN n USING (doc_id)""",
    "p4_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 1800",
    "p5_found": """
WITH v AS (
  SELECT DISTINCT slot, embedding::DOUBLE[] AS e FROM chunk_vectors
  WHERE slot IS NOT NULL AND len(embedding) = 96 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
s AS (SELECT a.slot AS x, b.slot AS y, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.slot <> b.slot),
r AS (SELECT x, y, c, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS place FROM s)
SELECT DISTINCT least(x, y) AS slot_a, greatest(x, y) AS slot_b FROM r WHERE place <= 8 AND c >= 0.85""",
}
