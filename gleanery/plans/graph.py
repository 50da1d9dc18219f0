"""Queries of the link graph: over the vault's pages and citations, and over a larger graph of orders, parts and suppliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import graph as G
from gleanery.operators import vault as V
from gleanery.plans.registry import query
from gleanery.session import stored
from gleanery.sources.tables import table

TODAY = "2026-07-15"

_CONTENT = r"(ends_with({0}, '.md') AND NOT regexp_matches({0}, '^(_templates|raw|log)/') AND {0} NOT IN ('index.md', 'log.md', 'vault-schema.md'))"


def content(c: str) -> str:
    return _CONTENT.replace("{0}", c)


#: SQL of pages, links and their resolution, for the queries below.
VAULT = rf"""wp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY loaded_at DESC) AS nth FROM wiki_pages) WHERE nth = 1),
allclips AS (SELECT DISTINCT clip_id, path, title, source, topic, created, captured_at, source_hash, md FROM clippings
  UNION ALL SELECT DISTINCT clip_id, path, title, source, topic, created, captured_at, source_hash, md FROM pdf_clips),
pages AS (
  SELECT path, lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(?i)\.md$', '')) AS name, title, page_status AS status, page_type AS type, words, created,
    CAST(updated_at AS DATE) AS updated, topic, NULL AS source, NULL AS source_hash, list_transform(source_hashes, lambda h: lower(trim(h))) AS source_hashes, coalesce(len(sources) = 0, false) AS declares FROM wp
  UNION ALL SELECT path, lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(?i)\.md$', '')), title, NULL, 'clip',
    len(regexp_extract_all(coalesce(md, ''), '\S+')), created, created, topic, source, nullif(lower(trim(source_hash)), ''), NULL, false FROM allclips),
rawlinks AS (
  SELECT path AS source, 'prov' AS channel, unnest(sources) AS entry FROM wp
  UNION ALL SELECT path, 'nav', unnest(regexp_extract_all(text, '\[\[([^\]|#]+)', 0)) FROM (SELECT DISTINCT chunk_id, path, text FROM chunks WHERE contains(text, '[['))),
links AS (SELECT source, channel, regexp_replace(regexp_extract(entry, '\[\[([^\]|#]+)', 1), '^\s+|\s+$', '', 'g') AS target FROM rawlinks
  WHERE regexp_replace(regexp_extract(entry, '\[\[([^\]|#]+)', 1), '^\s+|\s+$', '', 'g') <> ''),
keys AS (
  SELECT key, arg_min(path, (kind, path)) AS path, arg_min(path, (NOT content, path)) FILTER (WHERE kind = 0) AS nav FROM (
    SELECT name AS key, 0 AS kind, path, {content('path')} AS content FROM pages
    UNION ALL SELECT lower(regexp_replace(path, '(?i)\.md$', '')), 1, path, {content('path')} FROM pages) GROUP BY key),
resolved AS (
  SELECT l.*, coalesce(a.path, b.path, c.path) AS resolved,
    CASE WHEN channel = 'nav' THEN CASE WHEN a.path IS NOT NULL THEN coalesce(a.nav, a.path) WHEN b.path IS NOT NULL THEN coalesce(b.nav, b.path) ELSE coalesce(c.nav, c.path) END
      ELSE coalesce(a.path, b.path, c.path) END AS landed
  FROM links l LEFT JOIN keys a ON lower(l.target) = a.key LEFT JOIN keys b ON regexp_replace(lower(l.target), '\.md$', '') = b.key
  LEFT JOIN keys c ON CASE WHEN regexp_extract(regexp_replace(lower(l.target), '\.md$', ''), '([^/]*)$', 1) = '' THEN regexp_replace(lower(l.target), '\.md$', '')
    ELSE regexp_extract(regexp_replace(lower(l.target), '\.md$', ''), '([^/]*)$', 1) END = c.key),
inbound AS (SELECT landed AS path, count(*) AS inbound FROM resolved WHERE landed IS NOT NULL AND {content('source')} GROUP BY landed),
raw_citing AS (SELECT DISTINCT source AS path FROM resolved WHERE starts_with(resolved, 'raw/')),
broken AS (SELECT DISTINCT source, target FROM resolved WHERE landed IS NULL AND {content('source')})"""


def vault(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = V.pages(spark, d)
    return pages, G.resolve(V.links(spark, d), pages)


@query(f"WITH {VAULT} SELECT source, channel, target, resolved, landed, count(*) AS n FROM resolved GROUP BY ALL")
def gr_resolve_links(spark: SparkSession, d: str) -> DataFrame:
    return vault(spark, d)[1].groupBy("source", "channel", "target", "resolved", "landed").agg(F.count("*").alias("n"))


@query(f"WITH {VAULT} SELECT path, inbound FROM inbound")
def gr_inbound_degree(spark: SparkSession, d: str) -> DataFrame:
    return G.inbound(vault(spark, d)[1])


@query(f"WITH {VAULT} SELECT landed AS path, count(DISTINCT source) AS n FROM resolved WHERE landed IS NOT NULL AND landed <> source GROUP BY landed")
def gr_inbound_distinct(spark: SparkSession, d: str) -> DataFrame:
    return G.referrers(vault(spark, d)[1]).groupBy("path").agg(F.count("*").alias("n"))


@query(f"WITH {VAULT} SELECT path FROM pages WHERE {content('path')} AND NOT regexp_matches(path, '^(wiki/syntheses|moc)/') AND path NOT IN (SELECT path FROM inbound)")
def gr_orphans(spark: SparkSession, d: str) -> DataFrame:
    return G.orphans(*vault(spark, d))


@query(f"WITH {VAULT} SELECT path FROM pages WHERE {content('path')} AND path NOT IN (SELECT source FROM resolved WHERE channel = 'nav' AND landed IS NOT NULL)")
def gr_dead_ends(spark: SparkSession, d: str) -> DataFrame:
    return G.dead_ends(*vault(spark, d))


@query(f"WITH {VAULT} SELECT source, target FROM broken")
def gr_broken_links(spark: SparkSession, d: str) -> DataFrame:
    return G.broken(vault(spark, d)[1])


@query(f"WITH {VAULT} SELECT p.path FROM pages p WHERE starts_with(p.path, 'raw/') AND p.path NOT IN (SELECT path FROM inbound)")
def gr_unparsed_sources(spark: SparkSession, d: str) -> DataFrame:
    return G.unparsed(*vault(spark, d))


@query(
    f"""WITH {VAULT}, rec AS (SELECT DISTINCT unnest(source_hashes) AS h FROM pages WHERE starts_with(path, 'wiki/sources/')),
legacy AS (SELECT r.resolved AS path FROM resolved r JOIN pages p ON p.path = r.source WHERE starts_with(p.path, 'wiki/sources/') AND coalesce(len(p.source_hashes), 0) = 0 AND r.resolved IS NOT NULL)
SELECT path FROM pages p WHERE starts_with(path, 'raw/') AND ends_with(path, '.md') AND NOT EXISTS (SELECT 1 FROM rec WHERE rec.h = p.source_hash AND rec.h <> '') AND path NOT IN (SELECT path FROM legacy)"""
)
def gr_backlog(spark: SparkSession, d: str) -> DataFrame:
    return G.backlog(*vault(spark, d))


@query(f"WITH {VAULT} SELECT path FROM pages WHERE starts_with(path, 'raw/') AND ends_with(path, '.md') AND source_hash IS NULL")
def gr_missing_hash(spark: SparkSession, d: str) -> DataFrame:
    return G.missing_hash(V.pages(spark, d))


@query(f"WITH {VAULT} SELECT path FROM pages WHERE starts_with(path, 'wiki/sources/') AND coalesce(len(source_hashes), 0) = 0 AND path IN (SELECT path FROM raw_citing)")
def gr_backfill_pending(spark: SparkSession, d: str) -> DataFrame:
    return G.backfill_pending(*vault(spark, d))


@query(f"WITH {VAULT} SELECT path FROM pages WHERE starts_with(path, 'wiki/sources/') AND NOT declares AND path NOT IN (SELECT path FROM raw_citing)")
def gr_provenance_gaps(spark: SparkSession, d: str) -> DataFrame:
    return G.provenance_gaps(*vault(spark, d))


_WALK = """
e AS (SELECT DISTINCT source, resolved AS target FROM resolved WHERE resolved IS NOT NULL),
need AS (SELECT path, declares FROM pages WHERE starts_with(path, 'wiki/') AND NOT starts_with(path, 'wiki/sources/')),
h1 AS (SELECT DISTINCT path, target AS node FROM need JOIN e ON e.source = path WHERE regexp_matches(target, '^(raw|wiki/sources)/')),
h2 AS (SELECT DISTINCT path, target AS node FROM h1 JOIN e ON e.source = node),
h3 AS (SELECT DISTINCT path, target AS node FROM h2 JOIN e ON e.source = node),
walk AS (SELECT DISTINCT path, node AS evidence FROM (SELECT * FROM h1 UNION SELECT * FROM h2 UNION SELECT * FROM h3) WHERE regexp_matches(node, '^(raw|wiki/sources)/') AND node <> path)"""


@query(f"WITH {VAULT}, {_WALK} SELECT path, evidence FROM walk")
def gr_evidence_walk(spark: SparkSession, d: str) -> DataFrame:
    pages, resolved = vault(spark, d)
    need = pages.filter(F.col("path").startswith("wiki/") & ~F.col("path").startswith("wiki/sources/")).select("path")
    return G.evidence_walk(resolved.select("source", F.col("resolved").alias("target")), need, V.is_evidence)


@query(f"WITH {VAULT}, {_WALK} SELECT path FROM need WHERE NOT declares AND path NOT IN (SELECT path FROM walk WHERE starts_with(evidence, 'raw/'))")
def gr_unreachable(spark: SparkSession, d: str) -> DataFrame:
    return G.unreachable(*vault(spark, d))


#: A target over several lines, joined in the ways it may have been broken.
_JOINED = [rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))" for x in (r"regexp_replace(target, '-[ \t]*\r?\n[ \t]*', '-', 'g')", "target", r"regexp_replace(target, '-[ \t]*\r?\n[ \t]*', '', 'g')")]
_NORMAL = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_CLASSIFY = rf"""
known AS (SELECT {_NORMAL.replace('{0}', 'name')} AS nn, arg_min(coalesce(title, name), path) AS real, min(path) AS path FROM pages WHERE {content('path')} GROUP BY 1),
t AS (SELECT DISTINCT target, {_NORMAL.replace('{0}', 'target')} AS nt FROM broken WHERE NOT contains(target, chr(10))),
wrapped AS (SELECT DISTINCT target, {_NORMAL.replace('{0}', 'c')} AS n, c, i FROM (SELECT target, unnest([{_JOINED[0]}, {_JOINED[1]}, {_JOINED[2]}]) AS c, unnest([0, 1, 2]) AS i FROM (SELECT DISTINCT target FROM broken WHERE contains(target, chr(10))))),
meant AS (SELECT target, arg_min(c, i) AS suggest FROM wrapped JOIN known ON n = nn AND nn <> '' GROUP BY target HAVING count(DISTINCT n) = 1),
sug AS (SELECT * FROM meant UNION ALL SELECT target, arg_min(real, (rank, path)) AS suggest FROM (
  SELECT target, real, 0 AS rank, known.path FROM t JOIN known ON nt = nn AND nn <> '' WHERE real <> target
  UNION ALL SELECT target, real, 1, known.path FROM t JOIN known ON abs(length(nt) - length(nn)) <= 2 AND levenshtein(nt, nn) <= 2 WHERE nt <> '') GROUP BY target),
cls AS (SELECT b.source, b.target, CASE WHEN contains(b.target, chr(10)) OR suggest IS NOT NULL THEN 'defect'
    WHEN date_diff('day', coalesce(p.updated, p.created), DATE '{TODAY}') > 90 AND refs < 3 THEN 'stale' ELSE 'deferred' END AS class, suggest, refs
  FROM (SELECT *, count(*) OVER (PARTITION BY target) AS refs FROM broken) b LEFT JOIN sug ON sug.target = b.target LEFT JOIN pages p ON p.path = b.source)"""


@query(f"WITH {VAULT}, {_CLASSIFY} SELECT source, target, class, suggest, refs FROM cls")
def gr_broken_classify(spark: SparkSession, d: str) -> DataFrame:
    pages, resolved = vault(spark, d)
    return G.classify_broken(G.broken(resolved), pages, TODAY)


@query(
    f"""WITH {VAULT}, {_WALK}, {_CLASSIFY}, n AS (SELECT
  (SELECT count(*) FROM cls WHERE class = 'defect') AS defects, (SELECT count(*) FROM cls WHERE class = 'stale') AS stale,
  (SELECT count(*) FROM pages WHERE {content('path')} AND NOT regexp_matches(path, '^(wiki/syntheses|moc)/') AND path NOT IN (SELECT path FROM inbound)) AS orphans,
  (SELECT count(*) FROM pages WHERE {content('path')} AND path NOT IN (SELECT source FROM resolved WHERE channel = 'nav' AND landed IS NOT NULL)) AS dead_ends,
  (SELECT count(*) FROM pages WHERE starts_with(path, 'wiki/sources/') AND NOT declares AND path NOT IN (SELECT path FROM raw_citing)) AS provenance_gaps,
  (SELECT count(*) FROM need WHERE NOT declares AND path NOT IN (SELECT path FROM walk WHERE starts_with(evidence, 'raw/'))) AS unreachable)
SELECT *, CAST(greatest(0, 100 - least(30, 3 * defects) - least(15, 2 * stale) - least(25, 2 * orphans) - least(20, 2 * dead_ends) - least(20, 4 * provenance_gaps) - least(20, 3 * unreachable)) AS BIGINT) AS score FROM n"""
)
def gr_health_score(spark: SparkSession, d: str) -> DataFrame:
    # six measures read pages and links: both are made once and kept in the shared folder
    pages = stored(V.pages(spark, d), "pages")
    resolved = stored(G.resolve(V.links(spark, d), pages), "links")
    broken = stored(G.classify_broken(G.broken(resolved), pages, TODAY), "broken")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("finding"), "n")
    parts = [
        count(broken.filter("class = 'defect'"), "defects"), count(broken.filter("class = 'stale'"), "stale"), count(G.orphans(pages, resolved), "orphans"),
        count(G.dead_ends(pages, resolved), "dead_ends"), count(G.provenance_gaps(pages, resolved), "provenance_gaps"), count(G.unreachable(pages, resolved), "unreachable"),
    ]
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    return G.health(counts)


_MEASURES = {
    "orphans": f"SELECT path FROM pages WHERE {content('path')} AND NOT regexp_matches(path, '^(wiki/syntheses|moc)/') AND path NOT IN (SELECT path FROM inbound)",
    "dead_ends": f"SELECT path FROM pages WHERE {content('path')} AND path NOT IN (SELECT source FROM resolved WHERE channel = 'nav' AND landed IS NOT NULL)",
    "broken": "SELECT source FROM broken",
    "defects": "SELECT source FROM cls WHERE class = 'defect'",
    "stale": "SELECT source FROM cls WHERE class = 'stale'",
    "deferred": "SELECT source FROM cls WHERE class = 'deferred'",
    "hub_stubs": f"SELECT p.path FROM pages p JOIN inbound i USING (path) WHERE {content('p.path')} AND (coalesce(status = 'stub', false) OR coalesce(words, 0) < 10) AND inbound >= 5",
    "unparsed": "SELECT path FROM pages WHERE starts_with(path, 'raw/') AND path NOT IN (SELECT path FROM inbound)",
    "missing_hash": "SELECT path FROM pages WHERE starts_with(path, 'raw/') AND ends_with(path, '.md') AND source_hash IS NULL",
    "backfill_pending": "SELECT path FROM pages WHERE starts_with(path, 'wiki/sources/') AND coalesce(len(source_hashes), 0) = 0 AND path IN (SELECT path FROM raw_citing)",
    "provenance_gaps": "SELECT path FROM pages WHERE starts_with(path, 'wiki/sources/') AND NOT declares AND path NOT IN (SELECT path FROM raw_citing)",
    "unreachable": "SELECT path FROM need WHERE NOT declares AND path NOT IN (SELECT path FROM walk WHERE starts_with(evidence, 'raw/'))",
    "declared_gaps": "SELECT path FROM declared",
    "declared_stubs": f"SELECT path FROM pages WHERE {content('path')} AND status = 'stub'",
}
_DECLARED = f"""declared AS (SELECT path FROM pages WHERE declares AND {content('path')} AND CASE WHEN starts_with(path, 'wiki/sources/') THEN path NOT IN (SELECT path FROM raw_citing)
  ELSE path NOT IN (SELECT path FROM walk WHERE starts_with(evidence, 'raw/')) END)"""


@query(f"WITH {VAULT}, {_WALK}, {_DECLARED} SELECT path FROM declared")
def gr_declared_gaps(spark: SparkSession, d: str) -> DataFrame:
    return G.declared_gaps(*vault(spark, d))


@query(f"WITH {VAULT} {_MEASURES['declared_stubs']}")
def gr_declared_stubs(spark: SparkSession, d: str) -> DataFrame:
    return G.declared_stubs(V.pages(spark, d))


@query(f"WITH {VAULT}, {_WALK}, {_DECLARED}, {_CLASSIFY} " + " UNION ALL ".join(f"SELECT '{m}' AS measure, count(*) AS n FROM ({sql})" for m, sql in _MEASURES.items()))
def gr_health_measures(spark: SparkSession, d: str) -> DataFrame:
    """All measures of the link graph, scored or not, a row each."""
    pages = stored(V.pages(spark, d), "pages")
    resolved = stored(G.resolve(V.links(spark, d), pages), "links")
    bad = stored(G.classify_broken(G.broken(resolved), pages, TODAY), "broken")
    found = {
        "orphans": G.orphans(pages, resolved), "dead_ends": G.dead_ends(pages, resolved), "broken": bad, "defects": bad.filter("class = 'defect'"), "stale": bad.filter("class = 'stale'"),
        "deferred": bad.filter("class = 'deferred'"), "hub_stubs": G.hub_stubs(pages, resolved), "unparsed": G.unparsed(pages, resolved), "missing_hash": G.missing_hash(pages),
        "backfill_pending": G.backfill_pending(pages, resolved), "provenance_gaps": G.provenance_gaps(pages, resolved), "unreachable": G.unreachable(pages, resolved),
        "declared_gaps": G.declared_gaps(pages, resolved), "declared_stubs": G.declared_stubs(pages),
    }
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(m).alias("measure"), "n") for m, df in found.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


# A larger graph: orders lead to parts (nav), parts to their suppliers (prov); suppliers are raw, parts are source pages.


def _order(c: Column) -> Column:
    return F.concat(F.lit("wiki/concepts/o"), c, F.lit(".md"))


def _part(c: Column) -> Column:
    return F.concat(F.lit("wiki/sources/p"), c, F.lit(".md"))


def _supplier(c: Column) -> Column:
    return F.concat(F.lit("raw/s"), c, F.lit(".md"))


def supply_links(spark: SparkSession, d: str) -> DataFrame:
    """``source, channel, resolved, landed`` of the order graph, a row per line item and channel."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    nav = li.select(_order(F.col("l_orderkey")).alias("source"), F.lit("nav").alias("channel"), _part(F.col("l_partkey")).alias("resolved"))
    prov = li.select(_part(F.col("l_partkey")).alias("source"), F.lit("prov").alias("channel"), _supplier(F.col("l_suppkey")).alias("resolved"))
    return nav.unionByName(prov).withColumn("landed", F.col("resolved"))


SUPPLY = """sl AS (
  SELECT 'wiki/concepts/o' || l_orderkey || '.md' AS source, 'nav' AS channel, 'wiki/sources/p' || l_partkey || '.md' AS landed FROM lineitem
  UNION ALL SELECT 'wiki/sources/p' || l_partkey || '.md', 'prov', 'raw/s' || l_suppkey || '.md' FROM lineitem)"""


@query(f"WITH {SUPPLY} SELECT landed AS path, count(*) AS inbound FROM sl GROUP BY landed")
def gr_supply_inbound(spark: SparkSession, d: str) -> DataFrame:
    return G.inbound(supply_links(spark, d))


@query(f"WITH {SUPPLY} SELECT landed AS path, count(DISTINCT source) AS n FROM sl WHERE landed <> source GROUP BY landed")
def gr_supply_referrers(spark: SparkSession, d: str) -> DataFrame:
    return G.referrers(supply_links(spark, d)).groupBy("path").agg(F.count("*").alias("n"))


@query(
    f"""WITH {SUPPLY}, h1 AS (SELECT DISTINCT source AS path, landed AS node FROM sl WHERE starts_with(source, 'wiki/concepts/')),
h2 AS (SELECT DISTINCT path, landed AS node FROM h1 JOIN sl ON source = node) SELECT path, count(DISTINCT node) AS n FROM (SELECT * FROM h1 UNION SELECT * FROM h2) GROUP BY path"""
)
def gr_supply_evidence(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    # walked over as numbers (orders, parts and suppliers by their rest modulo 3); only the result's paths are spelt out
    order, part, supplier = (F.col(c) * 3 + i for i, c in enumerate(("l_orderkey", "l_partkey", "l_suppkey")))
    nav = li.select(order.alias("source"), part.alias("target")).distinct()
    prov = li.select(part.alias("source"), supplier.alias("target")).distinct()
    walk = G.evidence_walk(nav.unionByName(prov), li.select(order.alias("path")).distinct(), lambda node: F.pmod(node, F.lit(3)) > 0, edges_distinct=True)
    return walk.groupBy("path").agg(F.count("*").alias("n")).select(_order((F.col("path") / 3).cast("bigint")).alias("path"), "n")


@query(f"WITH {VAULT} SELECT target, count(*) AS refs FROM broken GROUP BY target HAVING count(*) >= 2")
def op_wanted_pages(spark: SparkSession, d: str) -> DataFrame:
    from gleanery.operators.catalog import wanted_pages

    return wanted_pages(G.broken(vault(spark, d)[1]), least=2)


@query(
    f"""WITH {SUPPLY}, i AS (SELECT landed AS path, count(*) AS inbound FROM sl GROUP BY landed)
SELECT path, inbound FROM part JOIN i ON path = 'wiki/sources/p' || p_partkey || '.md' WHERE p_size < 10 AND inbound >= 5"""
)
def gr_hub_stubs(spark: SparkSession, d: str) -> DataFrame:
    """Parts with a size below ten, taken as pages of so many words, that many line items refer to."""
    pages = table(spark, d, "part", "p_partkey", "p_size").select(_part(F.col("p_partkey")).alias("path"), F.lit(None).cast("string").alias("status"), F.col("p_size").alias("words"))
    return G.hub_stubs(pages, supply_links(spark, d))
