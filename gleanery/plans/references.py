"""Queries of problem 2: references to clips that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.operators import references
from gleanery.plans.registry import query
from gleanery.sources.tables import latest, table

#: Entries of wiki_pages and usable parents as SQL, shared by the queries of problem 2.
_ENTRIES = """
pages AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY loaded_at DESC) AS nth FROM wiki_pages) WHERE nth = 1),
raw AS (
  SELECT page_id, updated_at, 'sources' AS field, unnest(sources) AS entry, unnest(range(1, len(sources) + 1)) AS pos FROM pages WHERE len(sources) > 0
  UNION ALL
  SELECT page_id, updated_at, 'source_hashes', unnest(source_hashes), unnest(range(1, len(source_hashes) + 1)) FROM pages WHERE len(source_hashes) > 0),
entries AS (
  SELECT page_id, updated_at, field, CAST(pos AS INTEGER) AS pos, CASE WHEN field = 'sources' THEN 'name' ELSE 'hash' END AS kind,
    CASE WHEN field = 'sources' THEN
      trim(regexp_replace(trim(regexp_extract(trim(regexp_extract(CASE WHEN contains(entry, '[[') THEN regexp_extract(entry, '\\[\\[(.*?)\\]\\]', 1) ELSE entry END, '^([^|#]*)', 1)), '([^/]*)$', 1)), '\\.md$', ''))
    ELSE lower(trim(entry)) END AS key
  FROM raw WHERE entry IS NOT NULL AND trim(entry) <> ''),
clips AS (SELECT path, captured_at, source_hash FROM clippings UNION ALL SELECT path, captured_at, source_hash FROM pdf_clips),
kept AS (SELECT * FROM clips WHERE path NOT IN (SELECT from_path FROM purge_entries WHERE restored_at IS NULL AND from_path IS NOT NULL)),
parents AS (
  SELECT kind, key, min(captured) AS first_at FROM (
    SELECT 'name' AS kind, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.md$', '') AS key, captured_at AS captured FROM kept
    UNION ALL SELECT 'hash', lower(trim(source_hash)), captured_at FROM kept WHERE source_hash IS NOT NULL)
  GROUP BY kind, key),
flagged AS (
  SELECT e.*, p.first_at FROM entries e LEFT JOIN parents p ON e.kind = p.kind AND e.key = p.key)"""


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = latest(table(spark, d, "wiki_pages", "page_id", "updated_at", "sources", "source_hashes", "loaded_at"), "page_id")
    clips = ["path", "captured_at", "source_hash"]
    parents = references.usable_clips(table(spark, d, "clippings", *clips), table(spark, d, "pdf_clips", *clips), table(spark, d, "purge_entries", "from_path", "restored_at"))
    return references.reference_entries(pages), parents


@query(f"WITH {_ENTRIES} SELECT page_id, field, pos FROM flagged WHERE first_at IS NULL OR updated_at IS NULL OR first_at > updated_at")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphans(*_references(spark, d)).select("page_id", "field", "pos")


@query(
    f"""WITH {_ENTRIES} SELECT field, strftime(updated_at, '%Y-%m') AS month, count(*) AS n_refs,
  count(*) FILTER (WHERE first_at IS NULL OR updated_at IS NULL OR first_at > updated_at) AS n_orphans,
  count(*) FILTER (WHERE first_at > updated_at OR (updated_at IS NULL AND first_at IS NOT NULL)) AS n_later
FROM flagged GROUP BY ALL"""
)
def p2_report(spark: SparkSession, d: str) -> DataFrame:
    entries, parents = _references(spark, d)
    return references.orphan_report(entries, references.orphans(entries, parents))
