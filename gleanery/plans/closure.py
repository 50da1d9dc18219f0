"""Queries of topic closure, what it touches, and reconciling purges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import closure as C
from gleanery.operators import graph as G
from gleanery.operators import repair
from gleanery.operators import vault as V
from gleanery.plans.graph import SUPPLY, VAULT, supply_links, vault
from gleanery.plans.registry import query
from gleanery.sources.tables import table

#: Seeds of the closure over the order graph: the orders of one year.
_SEEDS = "o_orderdate < '1996-01-01'"


def _supply_closure(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    referrers = G.referrers(supply_links(spark, d))
    seeds = table(spark, d, "orders", "o_orderkey", "o_orderdate").filter(_SEEDS).select(F.concat(F.lit("wiki/concepts/o"), "o_orderkey", F.lit(".md")).alias("path"))
    return referrers, C.closure(referrers, seeds)


_CLOSURE = f"""{SUPPLY}, ref AS (SELECT DISTINCT landed AS path, source AS referrer FROM sl WHERE landed <> source),
t0 AS (SELECT 'wiki/concepts/o' || o_orderkey || '.md' AS path FROM orders WHERE {_SEEDS}),
t1 AS (SELECT path FROM ref GROUP BY path HAVING count(*) = count(*) FILTER (WHERE referrer IN (SELECT path FROM t0)) EXCEPT SELECT path FROM t0),
u1 AS (SELECT path FROM t0 UNION SELECT path FROM t1),
t2 AS (SELECT path FROM ref GROUP BY path HAVING count(*) = count(*) FILTER (WHERE referrer IN (SELECT path FROM u1)) EXCEPT SELECT path FROM u1),
taken AS (SELECT path, 0 AS round FROM t0 UNION ALL SELECT path, 1 FROM t1 UNION ALL SELECT path, 2 FROM t2)"""


@query(f"WITH {_CLOSURE} SELECT path, round FROM taken")
def gr_purge_closure(spark: SparkSession, d: str) -> DataFrame:
    return _supply_closure(spark, d)[1]


@query(f"WITH {_CLOSURE} SELECT referrer AS path, count(*) AS n FROM ref WHERE path IN (SELECT path FROM taken) AND referrer NOT IN (SELECT path FROM taken) GROUP BY referrer")
def gr_collateral(spark: SparkSession, d: str) -> DataFrame:
    return C.collateral(*_supply_closure(spark, d))


_BLOCK = """cites AS (SELECT DISTINCT source AS path, resolved AS cited FROM resolved WHERE channel = 'prov' AND resolved IS NOT NULL),
gone AS (SELECT DISTINCT from_path AS path FROM purge_entries WHERE from_path IS NOT NULL)"""


@query(
    f"""WITH {VAULT}, {_BLOCK} SELECT path FROM cites GROUP BY path
HAVING bool_and(cited IN (SELECT path FROM gone)) AND path NOT IN (SELECT path FROM gone)"""
)
def gr_blocking(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "purge_entries", "from_path").filter("from_path is not null").select(F.col("from_path").alias("path")).distinct()
    return C.blocking(vault(spark, d)[1], gone)


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Purge entries once each, numbered within their manifest by path and hash."""
    from pyspark.sql import Window

    rows = table(spark, d, "purge_entries", "purge_id", "from_path", "source_hash").distinct()
    order = Window.partitionBy("purge_id").orderBy("from_path", F.col("source_hash").asc_nulls_last())
    return rows.withColumn("entry", F.row_number().over(order))


_ENTRIES = "ent AS (SELECT *, row_number() OVER (PARTITION BY purge_id ORDER BY from_path, source_hash NULLS LAST) AS entry FROM (SELECT DISTINCT purge_id, from_path, source_hash FROM purge_entries))"


@query(
    f"""WITH {VAULT}, {_ENTRIES}, e AS (SELECT purge_id, entry, from_path, lower(source_hash) AS h FROM ent),
byp AS (SELECT from_path, min((purge_id, entry)) AS o FROM e JOIN pages ON path = from_path GROUP BY from_path),
falls AS (SELECT e.* FROM e LEFT JOIN byp USING (from_path) WHERE (o IS NULL OR o <> (purge_id, entry)) AND h IS NOT NULL AND h <> ''),
fh AS (SELECT h, min((purge_id, entry)) AS o FROM falls GROUP BY h),
claims AS (SELECT from_path AS path, o, 'path' AS reason FROM byp UNION ALL SELECT p.path, fh.o, 'source-hash' FROM pages p JOIN fh ON lower(p.source_hash) = fh.h),
best AS (SELECT path, min((o, reason)) AS c FROM claims GROUP BY path)
SELECT path, struct_extract(struct_extract(c, 1), 1) AS purge_id, struct_extract(c, 2) AS reason FROM best"""
)
def gr_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return C.reconcile(_entries(spark, d), V.pages(spark, d))


@query(f"WITH {VAULT} SELECT from_path, CASE WHEN from_path IN (SELECT path FROM pages) THEN 'skip' ELSE 'restore' END AS action FROM (SELECT DISTINCT from_path FROM purge_entries WHERE from_path IS NOT NULL)")
def op_restore_plan(spark: SparkSession, d: str) -> DataFrame:
    return C.restore_plan(table(spark, d, "purge_entries", "from_path"), V.pages(spark, d))


@query(
    f"""WITH {_ENTRIES} SELECT purge_id, from_path, '.recycle/' || purge_id || '/' || from_path || CASE WHEN n = 1 THEN '' ELSE '-resurrected-' || (n - 1) END AS bin_path
FROM (SELECT *, row_number() OVER (PARTITION BY purge_id, from_path ORDER BY entry) AS n FROM ent)"""
)
def op_bin_paths(spark: SparkSession, d: str) -> DataFrame:
    return C.bin_paths(_entries(spark, d))


def _citations(spark: SparkSession, d: str) -> DataFrame:
    links = V.links(spark, d).filter("channel = 'prov'").filter(F.col("source").startswith("wiki/sources/"))
    name = F.lower(F.regexp_replace(F.regexp_extract("target", r"([^/]*)$", 1), r"(?i)\.md$", ""))
    return links.select(F.col("source").alias("page"), name.alias("target")).distinct()


@query(
    rf"""WITH {VAULT},
cites AS (SELECT DISTINCT source AS page, lower(regexp_replace(regexp_extract(target, '([^/]*)$', 1), '(?i)\.md$', '')) AS target FROM links WHERE channel = 'prov' AND starts_with(source, 'wiki/sources/')),
cl AS (SELECT path, name, source_hash FROM pages WHERE type = 'clip'),
k AS (SELECT key, rank, count(DISTINCT path) AS n, arg_min(coalesce(source_hash, '-'), path) AS h FROM (
  SELECT name AS key, 0 AS rank, path, source_hash FROM cl UNION ALL SELECT regexp_replace(name, '-[0-9a-f]{{7}}(-\d+)?$', ''), 1, path, source_hash FROM cl) GROUP BY key, rank),
b AS (SELECT key, arg_min(n, rank) AS n, nullif(arg_min(h, rank), '-') AS source_hash FROM k GROUP BY key),
rec AS (SELECT DISTINCT path AS page, unnest(source_hashes) AS source_hash FROM pages WHERE starts_with(path, 'wiki/sources/')),
x AS (SELECT c.page, c.target, CASE WHEN b.n IS NULL THEN 'unresolved' WHEN b.n > 1 THEN 'ambiguous' WHEN b.source_hash IS NULL THEN 'nohash' WHEN rec.page IS NOT NULL THEN 'have' ELSE 'add' END AS class, b.source_hash
  FROM cites c LEFT JOIN b ON c.target = b.key LEFT JOIN rec ON rec.page = c.page AND rec.source_hash = b.source_hash)
SELECT page, target, class, CASE WHEN class IN ('add', 'have') THEN source_hash END AS source_hash FROM x"""
)
def rp_hash_backfill(spark: SparkSession, d: str) -> DataFrame:
    pages = V.pages(spark, d)
    recorded = pages.filter(F.col("path").startswith("wiki/sources/")).select(F.col("path").alias("page"), F.explode("source_hashes").alias("source_hash"))
    return repair.hash_backfill(_citations(spark, d), pages.filter("type = 'clip'"), recorded)


@query()
def rp_citation_repair(spark: SparkSession, d: str) -> DataFrame:
    pages, resolved = vault(spark, d)
    sources = pages.filter(F.col("path").startswith("wiki/sources/"))
    broken = resolved.filter("channel = 'prov' and resolved is null").select(F.col("source").alias("page"), "target").distinct()
    vouched = sources.select(F.col("path").alias("page"), F.explode("source_hashes").alias("source_hash")).join(pages.filter("type = 'clip'").select("path", "name", "source_hash"), "source_hash")
    cited = resolved.select(F.col("source").alias("page"), F.col("resolved").alias("path")).filter("path is not null")
    return repair.citation_repair(broken, vouched.join(cited, ["page", "path"], "left_anti").select("page", "path", "name").distinct())


_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query(
    rf"""WITH w AS (SELECT DISTINCT title, {_NORM.replace('{0}', 'title')} AS a FROM pdf_clips WHERE title IS NOT NULL AND {_NORM.replace('{0}', 'title')} <> ''),
k AS (SELECT DISTINCT title AS match, {_NORM.replace('{0}', 'title')} AS b FROM clippings WHERE title IS NOT NULL AND {_NORM.replace('{0}', 'title')} <> ''),
ex AS (SELECT title, count(*) AS n, min(match) AS match FROM w JOIN k ON a = b GROUP BY title),
near AS (SELECT DISTINCT title, match FROM w JOIN k ON (contains(b, ' ') AND contains(' ' || a || ' ', ' ' || b || ' ')) OR (contains(a, ' ') AND contains(' ' || b || ' ', ' ' || a || ' ')) WHERE title NOT IN (SELECT title FROM ex)),
s AS (SELECT title, count(*) AS n, min(match) AS match FROM near GROUP BY title)
SELECT title, match FROM (SELECT * FROM ex UNION ALL SELECT * FROM s) WHERE n = 1"""
)
def rp_title_match(spark: SparkSession, d: str) -> DataFrame:
    title = lambda n: table(spark, d, n, "title").filter("title is not null")
    return repair.title_match(title("pdf_clips"), title("clippings"))


@query(
    rf"""WITH {VAULT}, b AS (SELECT DISTINCT source AS path FROM pdf_clips WHERE source IS NOT NULL),
n AS (SELECT p.source AS path, count(DISTINCT r.source) AS n FROM resolved r JOIN (SELECT DISTINCT path, source FROM pdf_clips) p ON p.path = r.resolved WHERE p.source IS NOT NULL GROUP BY p.source),
tw AS (SELECT lower(trim(title)) AS k, min(path) AS twin FROM clippings WHERE title IS NOT NULL AND trim(title) <> '' GROUP BY 1)
SELECT b.path, CASE WHEN twin IS NOT NULL THEN 'move' WHEN regexp_matches(b.path, '(?i)\.(pdf|docx|xlsx|html?)$') THEN 'extract' ELSE 'blocked' END AS action, twin, coalesce(n.n, 0) AS n_citers
FROM b LEFT JOIN tw ON tw.k = lower(regexp_replace(trim(replace(regexp_replace(regexp_extract(b.path, '([^/\\]*)$', 1), '\.[A-Za-z0-9]{{1,5}}$', ''), '_', ' ')), '-[0-9a-f]{{7}}(-\d+)?$', '')) LEFT JOIN n ON n.path = b.path"""
)
def rp_binary_plan(spark: SparkSession, d: str) -> DataFrame:
    originals = table(spark, d, "pdf_clips", "path", "source").filter("source is not null").distinct()
    citers = vault(spark, d)[1].select("resolved", F.col("source").alias("page")).join(originals, F.col("resolved") == F.col("path")).select(F.col("source").alias("path"), "page")
    return repair.binary_plan(originals.select(F.col("source").alias("path")).distinct(), table(spark, d, "clippings", "path", "title").filter("title is not null"), citers)
