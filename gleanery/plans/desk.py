"""Queries of the desk and of the upkeep of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.urls import url_key
from gleanery.operators import desk, refresh
from gleanery.operators import graph as G
from gleanery.operators import vault as V
from gleanery.plans.capture import BLOCKED, blocklist
from gleanery.plans.graph import VAULT, vault
from gleanery.plans.registry import query
from gleanery.plans.text import DOCS, documents, sql_domain, sql_url
from gleanery.session import shared_dir
from gleanery.sources.tables import table


@query(f"WITH {VAULT} SELECT resolved AS path, min(source) AS cover FROM resolved WHERE starts_with(source, 'wiki/sources/') AND starts_with(resolved, 'raw/') GROUP BY resolved")
def op_covers(spark: SparkSession, d: str) -> DataFrame:
    return desk.covers(vault(spark, d)[1])


@query(f"WITH {VAULT} SELECT target, count(*) AS n, min(source) AS first_source FROM broken WHERE regexp_matches(target, '{desk.BINARY}') GROUP BY target")
def op_binary_citers(spark: SparkSession, d: str) -> DataFrame:
    return desk.binary_citers(G.broken(vault(spark, d)[1]))


_SUFFIXES = rf"list_transform(range(1, len(string_split({sql_domain('url')}, '.'))), lambda i: array_to_string(list_slice(string_split({sql_domain('url')}, '.'), i, len(string_split({sql_domain('url')}, '.'))), '.'))"


@query(
    f"""WITH f AS (SELECT lower({sql_url('source')}) AS url_key, min(source) AS url FROM pdf_clips WHERE source IS NOT NULL GROUP BY 1)
SELECT * FROM f WHERE url_key NOT IN (SELECT lower({sql_url('source')}) FROM clippings WHERE source IS NOT NULL)
  AND NOT coalesce(list_has_any({_SUFFIXES}, [{", ".join(repr(b) for b in BLOCKED)}]), false)
  AND url_key NOT IN (SELECT lower({sql_url('source')}) FROM pdf_clips WHERE fidelity = 'degraded' AND source IS NOT NULL)"""
)
def op_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of PDF files that no web clip has and that aren't blocked or declined."""
    pdf = table(spark, d, "pdf_clips", "source", "fidelity")
    declined = pdf.filter("fidelity = 'degraded' and source is not null").select(url_key(F.col("source")).alias("url_key")).distinct()
    return desk.candidates(pdf.select(F.col("source").alias("url")), table(spark, d, "clippings", F.col("source").alias("url")), blocklist(spark), declined)


@query(f"WITH {VAULT} SELECT type, count(*) AS n FROM pages WHERE topic IS NULL OR trim(topic) = '' GROUP BY type")
def op_queue_unattributed(spark: SparkSession, d: str) -> DataFrame:
    return desk.queue(V.pages(spark, d), "topic", "type", "")


_RULES = [(r"(?i)^---\n(?:.*\n)*?type: log", "log"), (r"(?i)\n## (method|método|méthode|verfahren)", "method"), (r"(?i)\n#+ (results|resultados|ergebnisse|résultats)", "results"), (r"\[\[", "linked")]


@query(
    f"""WITH {DOCS} SELECT doc_id, CASE {" ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for p, n in _RULES)} ELSE 'other' END AS class FROM docs"""
)
def op_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d, "text")
    return rows.select("doc_id", desk.classify(rows, "text", _RULES, "other").alias("class"))


@query(
    """WITH c AS (SELECT path, min(source) AS url FROM (SELECT path, source FROM clippings UNION ALL SELECT path, source FROM pdf_clips) WHERE regexp_matches(source, '(?i)^https?://') GROUP BY path)
SELECT e.purge_id, e.from_path, c.url FROM (SELECT DISTINCT purge_id, from_path FROM purge_entries) e LEFT JOIN c ON c.path = e.from_path"""
)
def op_enriched_manifest(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "clippings", "path", "source").unionByName(table(spark, d, "pdf_clips", "path", "source"))
    return desk.enriched(table(spark, d, "purge_entries", "purge_id", "from_path").distinct(), pages).select("purge_id", "from_path", "url")


@query()
def vx_refresh(spark: SparkSession, d: str) -> DataFrame:
    """An index of the documents built from nothing, then brought up to a later state of them; what the second run did."""
    import uuid

    root = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    docs = documents(spark, d, "text", "created", "n_chars").filter("text is not null and text <> ''")
    files = docs.select(F.concat(F.lit("wiki/"), "doc_id", F.lit(".md")).alias("path"), F.regexp_extract("text", r"(?m)^# +(.*?)[ \t\r]*$", 1).alias("title"), "text", F.col("created").alias("mtime"), F.length("text").alias("size"))
    refresh.refresh(spark, files, root)
    later = files.filter("mtime is null or mtime < date'2026-02-20'").withColumn("text", F.when(F.col("mtime") >= F.lit("2025-10-01").cast("date"), F.concat("text", F.lit("\n\nAdded."))).otherwise(F.col("text"))).withColumn("size", F.length("text"))
    done = refresh.refresh(spark, later, root)
    return spark.createDataFrame(sorted(done.items()), "what string, n long")
