"""Queries of capturing: fidelity, duplicates, blocked sites, outcomes, running lines, quotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions.urls import url_key
from gleanery.operators import capture as C
from gleanery.operators import graph as G
from gleanery.operators import lint, repair
from gleanery.operators import vault as V
from gleanery.plans.graph import VAULT, content, vault
from gleanery.plans.registry import query
from gleanery.plans.text import DOCS, documents, sql_domain, sql_matching, sql_url
from gleanery.sources.tables import latest, table

#: A blocklist for the queries: one site, and a parent of several.
BLOCKED = ["skaskath-chapter.invalid", "waimaim-imprint.example", "nothing.test"]

_PDF = "pdf AS (SELECT DISTINCT clip_id, path, title, source, source_hash, extraction, fidelity, captured_at, md FROM pdf_clips)"
_CLIP = "cl AS (SELECT DISTINCT clip_id, path, title, source, topic, source_hash, captured_at, md FROM clippings)"


def pdfs(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "pdf_clips"), "clip_id", ties=[F.lit(0)])


def clips(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "clippings"), "clip_id", ties=[F.lit(0)])


_FID = rf"""{_PDF}, f AS (SELECT clip_id, extraction, greatest(len(regexp_extract_all(coalesce(md, ''), '\S+')), 1) AS n_words, len(regexp_extract_all(coalesce(md, ''), '{C.MANGLED_MATH}')) AS mangled_math,
  length(coalesce(md, '')) - length(replace(coalesce(md, ''), '�', '')) AS replacements, len(regexp_extract_all(coalesce(md, ''), '{C.CID}')) AS cids,
  greatest(len(regexp_extract_all(coalesce(md, ''), '\S')), 1) AS solid, len(regexp_extract_all(coalesce(md, ''), '[A-Za-z]')) AS letters FROM pdf),
g AS (SELECT *, letters / solid AS letter_part, solid >= 200 AND letters / solid < 0.2 AS gibberish FROM f),
fid AS (SELECT *, (mangled_math >= 8 AND mangled_math / n_words > 0.005) OR cids > 5 OR replacements / n_words > 0.015 OR gibberish AS degraded FROM g)"""


@query(f"WITH {_FID} SELECT clip_id, n_words, mangled_math, replacements, cids, round(letter_part, 6) AS letter_part, gibberish, degraded, CASE WHEN degraded THEN 'degraded' WHEN extraction = 'table-aware' THEN 'tabular' WHEN extraction = 'table-flattened' THEN 'degraded' ELSE 'high' END AS label FROM fid")
def cap_fidelity(spark: SparkSession, d: str) -> DataFrame:
    rows = C.fidelity(pdfs(spark, d), "md")
    floor = F.when(F.col("extraction") == "table-aware", "tabular").when(F.col("extraction") == "table-flattened", "degraded")
    return rows.select("clip_id", "n_words", "mangled_math", "replacements", "cids", F.round("letter_part", 6).alias("letter_part"), "gibberish", "degraded", C.fidelity_label(F.col("degraded"), floor).alias("label"))


@query(
    f"""WITH {_FID}, k AS (SELECT DISTINCT p.source, p.clip_id, fid.* EXCLUDE (clip_id, extraction), coalesce(p.extraction, 'plain') || '-' || p.clip_id AS method FROM pdf p JOIN fid USING (clip_id) WHERE p.source_hash IS NOT NULL),
t AS (SELECT lower(trim(p.title)) AS title, k.* FROM k JOIN pdf p USING (clip_id))
SELECT title, clip_id FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY n_words < 100, degraded, (mangled_math + replacements + cids) / n_words, method) AS nth FROM t) WHERE nth = 1"""
)
def cap_better_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Of all extractions under one title the best."""
    rows = C.fidelity(pdfs(spark, d).filter("source_hash is not null"), "md").withColumn("title", F.lower(F.trim("title")))
    rows = rows.withColumn("method", F.concat(F.coalesce("extraction", F.lit("plain")), F.lit("-"), F.col("clip_id")))
    return C.better_extraction(rows, "title").select("title", "clip_id")


@query(
    rf"""WITH {_PDF}, p AS (SELECT clip_id, string_split(md, chr(12)) AS ps FROM pdf WHERE md IS NOT NULL),
pg AS (SELECT clip_id, len(ps) AS n, unnest(range(1, len(ps) + 1)) AS no, unnest(ps) AS t FROM p WHERE len(ps) >= 4),
l AS (SELECT clip_id, n, no, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM pg),
e AS (SELECT DISTINCT clip_id, n, no, regexp_replace(unnest([ls[1], ls[-1]]), '\d+', '#', 'g') AS line FROM l WHERE len(ls) > 0)
SELECT clip_id, line, count(*) AS pages FROM e GROUP BY clip_id, line HAVING count(*) >= greatest(3, floor(any_value(n) / 2))"""
)
def cap_running_lines(spark: SparkSession, d: str) -> DataFrame:
    return C.running_lines(pdfs(spark, d).filter("md is not null"), "clip_id", "md")


@query(
    rf"""WITH {_PDF}, l AS (SELECT clip_id, list_filter(list_transform(string_split(coalesce(md, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS a FROM pdf),
k AS (SELECT clip_id, list_distinct(list_filter(a, lambda x: length(x) <= 28 AND len(regexp_extract_all(x, '\S+')) <= 4)) AS k FROM l),
u AS (SELECT clip_id, unnest(k) AS key FROM k), al AS (SELECT DISTINCT clip_id, unnest(a) AS line FROM l),
p AS (SELECT DISTINCT u.clip_id, key FROM u JOIN al ON al.clip_id = u.clip_id AND starts_with(line, key) AND length(line) > length(key) + 3),
c AS (SELECT k.clip_id, len(k) AS n_keys, (SELECT count(*) FROM p WHERE p.clip_id = k.clip_id) AS p FROM k)
SELECT clip_id, n_keys, CASE WHEN n_keys >= 8 THEN p ELSE 0 END AS promoted, CASE WHEN n_keys >= 8 THEN round(p / n_keys, 3) ELSE 0.0 END AS promoted_part, n_keys >= 8 AND p / greatest(n_keys, 1) >= 0.35 AS tabular FROM c"""
)
def cap_tabularity(spark: SparkSession, d: str) -> DataFrame:
    return C.tabularity(pdfs(spark, d), "clip_id", "md", "md")


def _choice(o: str) -> str:
    can = "(title <> '' AND length(title) % 2 = 0)"
    tab = "(extraction IS NOT NULL AND starts_with(extraction, 'table'))"
    return f"""CASE WHEN '{o}' = 'reading-order' THEN CASE WHEN {tab} THEN 'reading-order-forced' END WHEN '{o}' = 'table' THEN CASE WHEN {can} THEN 'table-aware' ELSE 'error' END
  WHEN {tab} THEN CASE WHEN {can} THEN 'table-aware' ELSE 'table-flattened' END END"""


@query(f"WITH {_PDF} SELECT clip_id, {_choice('auto')} AS auto, {_choice('reading-order')} AS reading, {_choice('table')} AS aligned FROM pdf WHERE title IS NOT NULL")
def cap_extraction_choice(spark: SparkSession, d: str) -> DataFrame:
    tab = F.coalesce(F.col("extraction").startswith("table"), F.lit(False))
    can = (F.col("title") != "") & (F.length("title") % 2 == 0)
    pick = lambda o: C.extraction_choice(tab, can, F.lit(o))
    return pdfs(spark, d).filter("title is not null").select("clip_id", pick("auto").alias("auto"), pick("reading-order").alias("reading"), pick("table").alias("aligned"))


@query(
    f"""WITH {DOCS}, h AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS h, doc_kind = 'clipping' AS c FROM docs WHERE text IS NOT NULL),
g AS (SELECT h, count(*) AS n, count(*) FILTER (WHERE c) AS k FROM h GROUP BY h HAVING count(*) > 1)
SELECT path, h.h AS source_hash, CASE WHEN k = n THEN 'refuse_all_cited' WHEN k = 0 THEN 'refuse_none_cited' WHEN c THEN 'keep' ELSE 'remove' END AS action FROM h JOIN g USING (h)"""
)
def cap_duplicate_plan(spark: SparkSession, d: str) -> DataFrame:
    """Documents of equal text; those that are clippings count as cited."""
    rows = documents(spark, d, "text", "doc_kind").filter("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("source_hash"), "doc_kind")
    return C.duplicate_plan(rows, rows.filter("doc_kind = 'clipping'"))


_SECTION = "regexp_replace(source, '/[^/]*$', '')"


@query(f"WITH {_CLIP} SELECT lower({sql_url(_SECTION)}) AS url_key, count(*) AS n, min(path) AS first_path FROM cl WHERE source IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def cap_duplicate_urls(spark: SparkSession, d: str) -> DataFrame:
    """Sections of sites (URLs without their last part) captured more than once."""
    return C.duplicate_urls(clips(spark, d).withColumn("source", F.regexp_replace("source", "/[^/]*$", "")))


_LIST = ", ".join(f"'{b}'" for b in BLOCKED)
_SUFFIX = rf"list_transform(range(1, len(string_split({{0}}, '.'))), lambda i: array_to_string(list_slice(string_split({{0}}, '.'), i, len(string_split({{0}}, '.'))), '.'))"
_BLOCKED = f"coalesce(list_has_any({_SUFFIX.replace('{0}', sql_domain('source'))}, [{_LIST}]), false)"


def blocklist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b,) for b in BLOCKED], "domain string")


@query(f"WITH {_CLIP} SELECT clip_id, {_BLOCKED} AS is_blocked FROM cl")
def cap_blocklist(spark: SparkSession, d: str) -> DataFrame:
    return C.blocked(clips(spark, d).select("clip_id", "source"), "source", blocklist(spark)).select("clip_id", "is_blocked")


@query(
    f"""WITH {_CLIP}, a AS (SELECT *, lower({sql_url('source')}) AS k, nullif(lower(trim(source_hash)), '') AS h, {_BLOCKED} AS b FROM cl),
dec AS (SELECT DISTINCT lower({sql_url('source')}) AS k FROM pdf_clips WHERE fidelity = 'degraded' AND source IS NOT NULL),
fu AS (SELECT k, arg_min(clip_id, (captured_at, clip_id)) AS f FROM a WHERE k IS NOT NULL GROUP BY k), fh AS (SELECT h, arg_min(clip_id, (captured_at, clip_id)) AS f FROM a WHERE h IS NOT NULL GROUP BY h)
SELECT clip_id, CASE WHEN b THEN 'blocked' WHEN dec.k IS NOT NULL THEN 'declined' WHEN clip_id <> fu.f THEN 'duplicate_url' WHEN len(regexp_extract_all(coalesce(md, ''), '\\S+')) < 100 THEN 'thin'
  WHEN clip_id <> fh.f THEN 'duplicate_hash' ELSE 'clipped' END AS outcome FROM a LEFT JOIN dec ON dec.k = a.k LEFT JOIN fu ON fu.k = a.k LEFT JOIN fh ON fh.h = a.h"""
)
def cap_status_ladder(spark: SparkSession, d: str) -> DataFrame:
    declined = pdfs(spark, d).filter("fidelity = 'degraded' and source is not null").select(url_key(F.col("source")).alias("url_key"))
    rows = clips(spark, d).select("clip_id", "source", "source_hash", "captured_at", "md")
    return C.capture_status(rows, blocklist(spark), declined, T.word_count(F.coalesce("md", F.lit("")))).select("clip_id", "outcome")


_LONG = r"list_distinct(list_filter(string_split(regexp_replace(lower(coalesce({0}, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: length(w) > 5))"


@query(
    rf"""WITH {_CLIP}, w AS (SELECT clip_id, md, title, len(regexp_extract_all(coalesce(md, ''), '\S+')) AS n, {_LONG.replace('{0}', 'left(md, 400)')} AS t, {_LONG.replace('{0}', 'substr(md, 401)')} AS b FROM cl)
SELECT clip_id, CASE WHEN regexp_matches(coalesce(md, ''), '(?i)<(article|main)[ >]') AND n >= 50 THEN 'real' WHEN len(t) >= 8 AND len(list_intersect(t, b)) / greatest(len(t), 1) < 0.2 THEN 'wrong_node' ELSE 'empty_shell' END AS kind FROM w"""
)
def cap_short_extraction(spark: SparkSession, d: str) -> DataFrame:
    """The head of each page as its description against the rest as what was extracted."""
    md = F.coalesce(F.col("md"), F.lit(""))
    kind = C.short_extraction(F.substring(md, F.lit(401), F.length(md)), F.left(md, F.lit(400)), md)
    return clips(spark, d).select("clip_id", kind.alias("kind"))


@query(
    rf"""WITH {VAULT}, ck AS (SELECT DISTINCT chunk_id, path, text FROM chunks WHERE text IS NOT NULL),
q0 AS (SELECT chunk_id, path, unnest(list_concat(regexp_extract_all(text, '“([^“”]+?)”', 1), regexp_extract_all(regexp_replace(text, '“([^“”]+?)”', ' ', 'g'), '"([^"]*?)"', 1))) AS quote FROM ck),
q AS (SELECT DISTINCT path, quote FROM q0 WHERE len(regexp_extract_all(quote, '\S+')) >= 5),
ev AS (SELECT DISTINCT source AS path, resolved AS clip FROM resolved WHERE starts_with(resolved, 'raw/')),
bd AS (SELECT path AS clip, {sql_matching('md')} AS body FROM allclips WHERE md IS NOT NULL)
SELECT q.path, q.quote, coalesce(bool_or(contains(body, {sql_matching('quote')})), false) AS supported FROM q LEFT JOIN ev USING (path) LEFT JOIN bd USING (clip) GROUP BY ALL"""
)
def ln_quote_containment(spark: SparkSession, d: str) -> DataFrame:
    """Quotations in the pages' chunks, and whether a cited clip contains them."""
    ck = latest(table(spark, d, "chunks", "chunk_id", "path", "text", "loaded_at"), "chunk_id").filter("text is not null")
    q = ck.select("path", F.explode(T.quoted_spans(F.col("text"))).alias("quote")).distinct()
    evidence = vault(spark, d)[1].filter(F.col("resolved").startswith("raw/")).select(F.col("source").alias("path"), F.col("resolved").alias("clip")).distinct()
    body = lambda df: df.filter("md is not null").select(F.col("path").alias("clip"), T.matching_form(F.col("md")).alias("body"))
    bodies = body(clips(spark, d)).unionByName(body(pdfs(spark, d)))
    tried = q.join(evidence, "path", "left").join(bodies, "clip", "left")
    return tried.groupBy("path", "quote").agg(F.coalesce(F.bool_or(F.contains("body", T.matching_form(F.col("quote")))), F.lit(False)).alias("supported"))


_FRONT = r"^---\r?\n[\s\S]*?\r?\n---\r?\n?"


@query(
    rf"""WITH {VAULT}, ck AS (SELECT DISTINCT chunk_id, path, start_line, text FROM chunks WHERE text IS NOT NULL),
e AS (SELECT DISTINCT source, resolved AS target FROM resolved WHERE resolved IS NOT NULL),
h1 AS (SELECT DISTINCT source AS path, target AS node FROM e WHERE {content('source')} AND regexp_matches(target, '^(raw|wiki/sources)/')),
h2 AS (SELECT DISTINCT path, target AS node FROM h1 JOIN e ON e.source = node),
h3 AS (SELECT DISTINCT path, target AS node FROM h2 JOIN e ON e.source = node),
ev AS (SELECT DISTINCT path, node FROM (SELECT * FROM h1 UNION SELECT * FROM h2 UNION SELECT * FROM h3) WHERE regexp_matches(node, '^(raw|wiki/sources)/') AND node <> path),
tx AS (SELECT path AS node, md AS text FROM allclips WHERE md IS NOT NULL
  UNION ALL SELECT path, string_agg(text, chr(10) ORDER BY start_line, chunk_id) FROM ck WHERE starts_with(path, 'wiki/sources/') GROUP BY path),
tf AS (SELECT node, regexp_replace(text, '{_FRONT}', '') AS text FROM tx), bd AS (SELECT node, {sql_matching('text')} AS body FROM tf),
q0 AS (SELECT chunk_id, path, list_filter(list_concat(regexp_extract_all(text, '“([^“”]+?)”', 1), regexp_extract_all(regexp_replace(text, '“([^“”]+?)”', ' ', 'g'), '"([^"]*?)"', 1)), lambda x: len(regexp_extract_all(x, '\S+')) >= 5) AS qs
  FROM ck WHERE {content('path')}),
q AS (SELECT chunk_id, path, n AS quote_no, qs[n + 1] AS quote FROM (SELECT *, unnest(range(len(qs))) AS n FROM q0)),
f0 AS (SELECT *, list_filter(regexp_split_to_array(quote, '\.\.\.|…|\[[^\]]*\]'), lambda x: len(regexp_extract_all(x, '\S+')) >= 3) AS fs FROM q),
f1 AS (SELECT chunk_id, path, quote_no, quote, n, fs[n + 1] AS f FROM (SELECT *, unnest(range(len(fs))) AS n FROM f0)),
fr AS (SELECT chunk_id, path, quote_no, quote, n, regexp_replace({sql_matching('f')}, '{lint.EDGES}', '', 'g') AS fragment FROM f1),
ok AS (SELECT chunk_id, fr.path, quote_no, quote, n, coalesce(bool_or(contains(body, fragment)), false) AS ok FROM fr LEFT JOIN ev ON ev.path = fr.path LEFT JOIN bd USING (node) GROUP BY ALL)
SELECT chunk_id, quote_no, quote, count(*) FILTER (WHERE NOT ok) AS missing FROM ok GROUP BY ALL HAVING count(*) FILTER (WHERE NOT ok) > 0"""
)
def ln_unsupported_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quotations in the chunks of content pages of which a fragment stands in no evidence that the page's links lead to: raw
    clips and source pages, within three hops."""
    ck = latest(table(spark, d, "chunks", "chunk_id", "path", "start_line", "text", "loaded_at"), "chunk_id").filter("text is not null")
    quoted = lint.quotes(ck.filter(V.is_content(F.col("path"))), "chunk_id", "text")
    edges = vault(spark, d)[1].select("source", F.col("resolved").alias("target"))
    starts = ck.select("path").distinct().filter(V.is_content(F.col("path")))
    walk = G.evidence_walk(edges, starts, V.is_evidence)
    with_quotes = ck.join(quoted.select("chunk_id").distinct(), "chunk_id").select("chunk_id", "path")
    evidence = with_quotes.join(walk, "path").select("chunk_id", F.col("evidence").alias("source"))
    told = ck.filter(F.col("path").startswith("wiki/sources/")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "chunk_id", "text"))).alias("parts"))
    pages = told.select("path", F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("md"))
    texts = pages.unionByName(clips(spark, d).select("path", "md")).unionByName(pdfs(spark, d).select("path", "md")).filter("md is not null")
    bodies = texts.select(F.col("path").alias("source"), T.matching_form(F.regexp_replace("md", _FRONT, "")).alias("body"))
    return lint.unsupported_quotes(quoted, evidence, bodies, "chunk_id")


@query()
def cap_html_extract(spark: SparkSession, d: str) -> DataFrame:
    """Captured pages set as simple web pages and extracted again."""
    from gleanery.sources.files import extract_pages

    escaped = F.replace(F.replace(F.col("md"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<html><head><title>"), F.col("title"), F.lit("</title></head><body><nav>Menu</nav><article><p>"), F.replace(escaped, F.lit("\n\n"), F.lit("</p><p>")), F.lit("</p></article></body></html>"))
    return extract_pages(clips(spark, d).filter("md is not null and title is not null").withColumn("html", html), "clip_id", "html").select("clip_id", "title", "words")


@query(
    rf"""WITH {_CLIP}, s AS (SELECT clip_id, coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(regexp_replace(title, '[\\/:*?"<>|#^\[\]]+', '-', 'g'), '\s+', ' ', 'g'), '-{{2,}}', '-', 'g'), 120), '^[-. ]+|[-. ]+$', '', 'g'), ''), 'untitled') AS s, coalesce(left(source_hash, 7), '') AS h FROM cl WHERE title IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY clip_id) AS n FROM s)
SELECT clip_id, CASE WHEN n = 1 THEN s WHEN n = 2 THEN s || '-' || h ELSE s || '-' || h || '-' || (n - 1) END AS slug FROM n"""
)
def cap_distinct_slugs(spark: SparkSession, d: str) -> DataFrame:
    return repair.distinct_slugs(clips(spark, d).filter("title is not null"), "clip_id", "title", "source_hash")


@query(
    f"""WITH {_FID}, x AS (SELECT p.path, p.source, p.captured_at, fid.degraded FROM pdf p JOIN fid USING (clip_id) WHERE p.source IS NOT NULL)
SELECT lower({sql_url('source')}) AS url_key, arg_max(path, path) AS path, count(*) AS n, bool_or(degraded) AS degraded FROM x GROUP BY 1"""
)
def cap_reclip_work(spark: SparkSession, d: str) -> DataFrame:
    """Per URL the last clip and whether any capture of it is degraded."""
    rows = C.fidelity(pdfs(spark, d).filter("source is not null"), "md")
    return rows.groupBy(url_key(F.col("source")).alias("url_key")).agg(F.max("path").alias("path"), F.count("*").alias("n"), F.bool_or("degraded").alias("degraded"))

