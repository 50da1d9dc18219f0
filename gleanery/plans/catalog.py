"""Queries of catalogs, freshness and operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import catalog as C
from gleanery.operators import repair
from gleanery.operators import vault as V
from gleanery.plans.graph import TODAY, VAULT, content
from gleanery.plans.registry import query
from gleanery.plans.text import DOCS, documents
from gleanery.sources.tables import latest, table

_WP = "wp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY loaded_at DESC) AS nth FROM wiki_pages) WHERE nth = 1)"
_SECTIONS = ", ".join(f"'{s}'" for s in C.SECTIONS)


def wiki(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest(table(spark, d, "wiki_pages", "page_id", "loaded_at", *columns), "page_id")


@query(
    f"""WITH {VAULT}, c AS (SELECT CASE WHEN type IN ({_SECTIONS}) THEN type ELSE 'other' END AS section, path, '- [[' || name || ']]' || CASE WHEN status = 'stub' THEN ' (stub)' ELSE '' END AS entry
  FROM pages WHERE {content('path')})
SELECT section, CAST(CASE WHEN list_position([{_SECTIONS}], section) IS NULL OR list_position([{_SECTIONS}], section) = 0 THEN {len(C.SECTIONS) + 1} ELSE list_position([{_SECTIONS}], section) END AS INTEGER) AS place, path, entry FROM c"""
)
def ct_catalog(spark: SparkSession, d: str) -> DataFrame:
    return C.catalog(V.pages(spark, d))


@query(
    f"""WITH {DOCS} SELECT lower(source) AS key, arg_min(source, doc_id) AS label, count(*) AS n FROM docs WHERE source IS NOT NULL AND trim(source) <> '' GROUP BY 1 HAVING count(*) >= 2"""
)
def ct_project_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d, "source")
    return C.groups(rows, T.topic_key(F.col("source")), T.topic_label(F.col("source")), "doc_id", least=2)


def _vocabulary(order: list[str], keep: bool, table_: str, column: str) -> str:
    words = ", ".join(f"'{w}'" for w in order)
    value = f"CASE WHEN {column} IN ({words}) THEN {column} ELSE 'other' END"
    where = "" if keep else f"WHERE {column} IN ({words})"
    return f"""SELECT v AS value, CAST(CASE WHEN v = 'other' THEN {len(order) + 1} ELSE list_position([{words}], v) END AS INTEGER) AS place, count(*) AS n FROM (SELECT {value} AS v FROM {table_} {where}) GROUP BY v"""


#: Kinds of the synthetic documents in an order of their own.
_KINDS = ["moc", "synthesis", "concept", "source"]


@query(f"WITH {DOCS} {_vocabulary(_KINDS, True, 'docs', 'doc_kind')}")
def ct_kind_groups(spark: SparkSession, d: str) -> DataFrame:
    return C.vocabulary_groups(documents(spark, d, "doc_kind"), "doc_kind", _KINDS, True)


@query(f"WITH {_WP} {_vocabulary(['stub', 'draft', 'maintained'], False, 'wp', 'page_status')}")
def ct_status_groups(spark: SparkSession, d: str) -> DataFrame:
    return C.vocabulary_groups(wiki(spark, d, "page_status"), "page_status", ["stub", "draft", "maintained"], False)


@query(
    f"""WITH {_WP}, a AS (SELECT path, date_diff('day', greatest(reviewed, CAST(updated_at AS DATE)), DATE '{TODAY}') AS age FROM wp)
SELECT path, CAST(age AS INTEGER) AS age_days, CASE WHEN age < 30 THEN 'fresh' WHEN age < 90 THEN 'aging' WHEN age < 180 THEN 'stale' ELSE 'rotten' END AS bucket FROM a"""
)
def fr_stale_buckets(spark: SparkSession, d: str) -> DataFrame:
    return C.freshness(wiki(spark, d, "path", "reviewed", "updated_at"), "path", "reviewed", "updated_at", TODAY)


@query(f"WITH {_WP} SELECT path, reviewed, page_type FROM wp WHERE starts_with(path, 'wiki/') AND reviewed < DATE '{TODAY}' - INTERVAL 90 DAY")
def fr_overdue_view(spark: SparkSession, d: str) -> DataFrame:
    return C.overdue(wiki(spark, d, "path", "reviewed", "page_type"), "wiki", "path", "reviewed", TODAY).select("path", "reviewed", "page_type")


@query("SELECT path FROM clippings EXCEPT SELECT from_path FROM purge_entries WHERE from_path IS NOT NULL")
def op_delta_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clippings", "path").subtract(table(spark, d, "purge_entries", F.col("from_path").alias("path")).filter("path is not null"))


@query(
    f"""WITH {_WP} SELECT coalesce(topic, '') AS topic, count(*) AS n, CAST(sum(coalesce(words, 0)) AS BIGINT) AS words, count(*) FILTER (WHERE page_status = 'stub') AS stubs, count(reviewed) AS reviewed FROM wp GROUP BY 1"""
)
def ct_topic_report(spark: SparkSession, d: str) -> DataFrame:
    rows = wiki(spark, d, "topic", "words", "page_status", "reviewed")
    return rows.groupBy(F.coalesce("topic", F.lit("")).alias("topic")).agg(
        F.count("*").alias("n"), F.sum(F.coalesce("words", F.lit(0))).alias("words"), F.count_if(F.col("page_status") == "stub").alias("stubs"), F.count("reviewed").alias("reviewed")
    )


@query()
def rp_roadmap_items(spark: SparkSession, d: str) -> DataFrame:
    return repair.roadmap_items(documents(spark, d, "text"), "doc_id", "text")


@query()
def rp_dewrap(spark: SparkSession, d: str) -> DataFrame:
    """Link targets over several lines and the page they can only mean."""
    targets = documents(spark, d, "text").select(F.explode(T.wikilinks(F.col("text"))).alias("target")).filter(F.col("target").contains("\n"))
    return repair.resolve_dewrap(targets, table(spark, d, "wiki_pages", F.col("title").alias("name")).filter("name is not null"))
