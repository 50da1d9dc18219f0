"""Queries of the upkeep of a vault."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import graph as G
from gleanery.operators import upkeep as U
from gleanery.operators import vault as V
from gleanery.plans.catalog import _WP, wiki
from gleanery.plans.graph import VAULT, content, vault
from gleanery.plans.registry import query
from gleanery.session import stored
from gleanery.sources.tables import latest, table

_CL = "cl AS (SELECT DISTINCT clip_id, path, source, topic, quality, created FROM clippings)"
_PDF = "pdf AS (SELECT DISTINCT clip_id, path, source, fidelity, extraction, md FROM pdf_clips)"


def _clips(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return latest(table(spark, d, name, "clip_id", "loaded_at", *columns), "clip_id", ties=[F.lit(0)])


@query(
    f"""WITH {_CL}, p AS (SELECT clip_id, CASE WHEN quality = 'high' THEN 2 ELSE 0 END + CASE WHEN created >= DATE '2023-07-15' THEN 1 ELSE 0 END + CASE WHEN topic IS NOT NULL THEN 1 ELSE 0 END
  - CASE WHEN quality = 'low' OR source IS NULL THEN 1 ELSE 0 END AS points FROM cl)
SELECT clip_id, CASE WHEN points >= 4 THEN 'high' WHEN points >= 2 THEN 'medium' WHEN points >= 0 THEN 'low' ELSE 'reject' END AS grade FROM p"""
)
def op_credibility(spark: SparkSession, d: str) -> DataFrame:
    """Clips graded by what the table says of them: quality, age, a topic, an address."""
    flags = {"primary": F.col("quality") == "high", "recent": F.col("created") >= F.lit("2023-07-15").cast("date"), "known_author": F.col("topic").isNotNull(), "promotional": (F.col("quality") == "low") | F.col("source").isNull()}
    return _clips(spark, d, "clippings", "quality", "created", "topic", "source").select("clip_id", U.credibility(flags).alias("grade"))


@query(f"WITH {_PDF} SELECT clip_id, fidelity FROM pdf WHERE fidelity <> '' AND fidelity NOT IN ('high', 'ok', 'clean')")
def cap_flagged_readings(spark: SparkSession, d: str) -> DataFrame:
    return _clips(spark, d, "pdf_clips", "fidelity").filter(U.is_flagged(F.col("fidelity"))).select("clip_id", "fidelity")


@query(
    rf"""WITH {_PDF}, w AS (SELECT clip_id, len(regexp_extract_all(coalesce(md, ''), '\S+')) AS words, coalesce(fidelity = 'degraded', false) AS degraded, coalesce(extraction = 'ocr', false) AS ocr FROM pdf)
SELECT clip_id, CASE WHEN ocr THEN 'thin' ELSE 'ocr-unavailable' END AS outcome, words < 100 OR degraded AS tried FROM w"""
)
def cap_recognition(spark: SparkSession, d: str) -> DataFrame:
    """Which readings are thin or degraded, and what they would be put down as; recognition counts as there where it was used."""
    from gleanery.functions import text as T

    words = T.word_count(F.coalesce("md", F.lit("")))
    degraded = F.coalesce(F.col("fidelity") == "degraded", F.lit(False))
    return _clips(spark, d, "pdf_clips", "md", "fidelity", "extraction").select("clip_id", U.thin_outcome(F.col("extraction") == "ocr").alias("outcome"), U.tries_recognition(words, degraded).alias("tried"))


@query(f"WITH {_WP} SELECT path FROM wp WHERE starts_with(path, 'wiki/') ORDER BY path LIMIT 25")
def op_seeds(spark: SparkSession, d: str) -> DataFrame:
    return U.seeds(wiki(spark, d, "path"))


@query(f"WITH {_WP} SELECT path FROM wp WHERE regexp_matches(path, '^wiki/(concepts|syntheses)/')")
def op_drift_scope(spark: SparkSession, d: str) -> DataFrame:
    return wiki(spark, d, "path").filter(U.is_drift_scope(F.col("path"))).select("path")


@query(f"WITH {_WP} SELECT path, page_type, created FROM wp")
def ct_log_view(spark: SparkSession, d: str) -> DataFrame:
    return U.log_view(wiki(spark, d, "path", "page_type", "created"), "path", "page_type", "created", date="created")


_DECLINED = """m AS (SELECT e.purged_at AS seen, c.source AS url FROM purge_entries e JOIN (SELECT DISTINCT path, source FROM clippings UNION SELECT DISTINCT path, source FROM pdf_clips) c ON c.path = e.from_path WHERE c.source IS NOT NULL),
gone AS (SELECT DISTINCT lower(source) AS k FROM clippings WHERE quality = 'low' AND source IS NOT NULL)"""


@query(f"WITH {_DECLINED} SELECT arg_min(url, (seen, url)) AS url FROM m WHERE lower(url) NOT IN (SELECT k FROM gone) GROUP BY lower(url)")
def op_replayed_declines(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of purged clips, as declined with them, that no clip of low quality declines now."""
    clips = table(spark, d, "clippings", "path", "source").unionByName(table(spark, d, "pdf_clips", "path", "source")).distinct()
    entries = table(spark, d, "purge_entries", F.col("from_path").alias("path"), F.col("purged_at").alias("at"))
    return U.replayed_declines(entries.join(clips, "path").select("at", F.col("source").alias("url")), table(spark, d, "clippings", "source", "quality").filter("quality = 'low'").select(F.col("source").alias("url")))


@query(
    """WITH t AS (SELECT DISTINCT purge_id AS id FROM purge_entries), w AS (SELECT DISTINCT regexp_replace(id, '-[0-9]+$', '') AS id FROM t),
n AS (SELECT w.id, (SELECT min(k) FROM range(1, 10000) r(k) WHERE CASE WHEN k = 1 THEN w.id ELSE w.id || '-' || k END NOT IN (SELECT id FROM t)) AS k FROM w)
SELECT id, CASE WHEN k = 1 THEN id ELSE id || '-' || k END AS free FROM n"""
)
def op_free_ids(spark: SparkSession, d: str) -> DataFrame:
    """The next free id for every base of the ids in use."""
    taken = table(spark, d, "purge_entries", F.col("purge_id").alias("id")).distinct()
    return U.free_ids(taken.select(F.regexp_replace("id", "-[0-9]+$", "").alias("id")), taken)


@query("SELECT purge_id, count(*) AS n, arg_min('{\"layer\":\"' || layer || '\",\"from_path\":\"' || from_path || '\"}', (layer, from_path)) AS first_entry FROM (SELECT DISTINCT purge_id, layer, from_path FROM purge_entries) GROUP BY purge_id")
def op_manifests(spark: SparkSession, d: str) -> DataFrame:
    return U.manifests(table(spark, d, "purge_entries", "purge_id", "layer", "from_path").distinct(), "purge_id", "layer", "from_path")


@query("SELECT from_path AS path FROM purge_entries WHERE from_path IS NOT NULL UNION SELECT path FROM wiki_pages WHERE page_status = 'stub'")
def op_touched_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of the manifests and of the pages a run touched (the stubs), once each."""
    one = table(spark, d, "purge_entries", F.col("from_path").alias("path")).filter("path is not null")
    return one.union(table(spark, d, "wiki_pages", "path", "page_status").filter("page_status = 'stub'").select("path")).distinct()


@query(f"WITH {_WP} SELECT topic AS project, CAST(list_position(['stub', 'draft', 'maintained', 'other'], coalesce(page_status, 'other')) AS INTEGER) AS place, coalesce(page_status, 'other') AS status, path FROM wp WHERE topic IS NOT NULL")
def ct_roadmap(spark: SparkSession, d: str) -> DataFrame:
    """Pages per topic and status, as the items of a backlog."""
    return U.roadmap(wiki(spark, d, "topic", "page_status", "path"), "topic", "page_status", ["stub", "draft", "maintained"])


@query(
    f"""WITH {VAULT}, f AS (SELECT DISTINCT source, target, CASE WHEN contains(target, ' ') THEN 'title' ELSE 'name' END AS category FROM broken),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY target, source) AS nth FROM f)
SELECT category, count(*) AS n, string_agg(target || ' in ' || source, chr(10) ORDER BY target || ' in ' || source) FILTER (WHERE k <= 5) AS first
FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY target || ' in ' || source) AS k FROM r) GROUP BY category"""
)
def ln_tally(spark: SparkSession, d: str) -> DataFrame:
    """Broken links by whether they name a title or a name, with the first few."""
    bad = G.broken(vault(spark, d)[1])
    kind = F.when(F.col("target").contains(" "), "title").otherwise("name")
    return U.tally(bad.select(kind.alias("category"), F.concat("target", F.lit(" in "), "source").alias("item")), "category", "item")


@query(
    f"""WITH {VAULT}, {_PDF}, fid AS (SELECT DISTINCT path AS url FROM pdf WHERE fidelity <> '' AND fidelity NOT IN ('high', 'ok', 'clean')),
hub AS (SELECT p.path AS url FROM pages p JOIN inbound i USING (path) WHERE {content('p.path')} AND (coalesce(status = 'stub', false) OR coalesce(words, 0) < 10) AND inbound >= 2),
un AS (SELECT path AS url FROM pages WHERE starts_with(path, 'raw/') AND path NOT IN (SELECT path FROM inbound))
SELECT 'fidelity' AS list, url, (SELECT count(*) FROM fid) AS total FROM fid
UNION ALL SELECT 'unparsed', url, (SELECT count(*) FROM un) FROM (SELECT url FROM un ORDER BY url LIMIT 25)
UNION ALL SELECT 'hub_stubs', url, (SELECT count(*) FROM hub) FROM (SELECT url FROM hub ORDER BY url LIMIT 25)"""
)
def op_desk_bundle(spark: SparkSession, d: str) -> DataFrame:
    """The desk's lists: readings that ask for a look, clips nothing cites, stubs that many pages link to; with their sizes."""
    pages = stored(V.pages(spark, d), "pages")
    resolved = stored(G.resolve(V.links(spark, d), pages), "links")
    flagged = _clips(spark, d, "pdf_clips", "path", "fidelity").filter(U.is_flagged(F.col("fidelity"))).select(F.col("path").alias("url")).distinct()
    return U.bundle(
        {"fidelity": flagged, "unparsed": G.unparsed(pages, resolved).select(F.col("path").alias("url")), "hub_stubs": G.hub_stubs(pages, resolved, least=2).select(F.col("path").alias("url"))},
        {"unparsed": 25, "hub_stubs": 25},
    )


@query()
def cap_without_running_lines(spark: SparkSession, d: str) -> DataFrame:
    return _clips(spark, d, "pdf_clips", "md").filter("md is not null").select("clip_id", F.sha2(U.without_running_lines(F.col("md")), 256).alias("hash"))
