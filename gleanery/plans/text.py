"""Queries of the column functions over documents, titles and URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions import urls as U
from gleanery.operators import chunking, lint, repair
from gleanery.operators.vault import pages
from gleanery.plans.registry import query
from gleanery.sources.tables import latest, table

#: SQL of the newest version per id, as ``latest`` picks it where versions differ in ``loaded_at``.
DOCS = "docs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC) AS nth FROM documents) WHERE nth = 1)"
_FM = r"regexp_extract(text, '(?s)^---\r?\n(.*?)\r?\n---', 1)"
_BODY = r"regexp_replace(text, '(?s)^---\r?\n(.*?)\r?\n---(\r?\n)?', '')"


def documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest(table(spark, d, "documents", "doc_id", "loaded_at", *columns), "doc_id")


def _sql_field(name: str) -> str:
    return rf"""nullif(regexp_replace(regexp_extract({_FM}, '(?m)^{name}:[ \t]*(.*?)[ \t\r]*$', 1), '^["'']|["'']$', '', 'g'), '')"""


@query(
    rf"""WITH {DOCS} SELECT doc_id, {_sql_field("type")} AS type, {_sql_field("created")} AS created, {_sql_field("title")} AS title,
  {_sql_field("source-hash")} AS source_hash, regexp_matches({_FM}, '(?m)^sources:[ \t]*\[[ \t]*\][ \t\r]*$') AS declares_no_sources,
  len(regexp_extract_all({_BODY}, '\S+')) AS words FROM docs WHERE text IS NOT NULL"""
)
def sf_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    fm = T.frontmatter(F.col("text"))
    rows = documents(spark, d, "text").filter("text is not null")
    return rows.select(
        "doc_id", T.field(fm, "type").alias("type"), T.field(fm, "created").alias("created"), T.field(fm, "title").alias("title"), T.field(fm, "source-hash").alias("source_hash"),
        T.declares_no_sources(fm).alias("declares_no_sources"), T.word_count(T.body(F.col("text"))).alias("words"),
    )


@query(
    rf"""WITH {DOCS}, l AS (SELECT doc_id, unnest(regexp_extract_all({_BODY}, '\[\[([^\]|#]+)', 1)) AS t FROM docs WHERE text IS NOT NULL)
SELECT doc_id, regexp_replace(t, '^\s+|\s+$', '', 'g') AS target, count(*) AS n FROM l WHERE regexp_replace(t, '^\s+|\s+$', '', 'g') <> '' GROUP BY ALL"""
)
def sf_wikilinks(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d, "text").select("doc_id", F.explode(T.wikilinks(T.body(F.col("text")))).alias("target"))
    return rows.groupBy("doc_id", "target").agg(F.count("*").alias("n"))


_URL = r"(?i)^([a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(:\d+)?([^?#]*)(\?[^#]*)?"


def sql_url(c: str) -> str:
    """SQL of the normal form of a URL."""
    g = lambda n: f"regexp_extract(trim({c}), '{_URL}', {n})"
    port = f"CASE WHEN (lower({g(1)}) = 'http' AND {g(3)} = ':80') OR (lower({g(1)}) = 'https' AND {g(3)} = ':443') THEN '' ELSE {g(3)} END"
    return f"CASE WHEN {g(2)} = '' THEN {c} ELSE lower({g(1)}) || '://' || lower({g(2)}) || {port} || regexp_replace({g(4)}, '/$', '') || {g(5)} END"


def sql_domain(c: str) -> str:
    return rf"nullif(regexp_replace(lower(regexp_extract(trim({c}), '{_URL}', 2)), '^www\.', ''), '')"


_CLIPS = "clips AS (SELECT DISTINCT clip_id, path, title, source, topic, created, captured_at, source_hash, md FROM clippings)"


@query(f"WITH {_CLIPS} SELECT clip_id, {sql_url('source')} AS url, {sql_domain('source')} AS domain FROM clips WHERE source IS NOT NULL")
def sf_normal_url(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "clippings", "clip_id", "source").filter("source is not null").distinct()
    return rows.select("clip_id", U.normal_url(F.col("source")).alias("url"), U.domain_of(F.col("source")).alias("domain"))


@query(
    r"""WITH t AS (SELECT DISTINCT title FROM clippings WHERE title IS NOT NULL)
SELECT title,
  coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(regexp_replace(title, '[\\/:*?"<>|#^\[\]]+', '-', 'g'), '\s+', ' ', 'g'), '-{2,}', '-', 'g'), 120), '^[-. ]+|[-. ]+$', '', 'g'), ''), 'untitled') AS slug,
  coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), '-+$', ''), ''), 'entry') AS log_slug,
  coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(title), '[''’]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled') AS kebab,
  trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS normal_name FROM t"""
)
def sf_slugs(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    rows = table(spark, d, "clippings", "title").filter("title is not null").distinct()
    return rows.select("title", T.slug(t).alias("slug"), T.log_slug(t).alias("log_slug"), T.kebab(t).alias("kebab"), T.normal_name(t).alias("normal_name"))


@query(
    r"""WITH p AS (SELECT DISTINCT path, source FROM pdf_clips)
SELECT path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(?i)\.md$', '') AS name,
  regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(?i)\.md$', ''), '-[0-9a-f]{7}(-\d+)?$', '') AS bare,
  trim(replace(regexp_replace(regexp_extract(source, '([^/\\]*)$', 1), '\.[A-Za-z0-9]{1,5}$', ''), '_', ' ')) AS file_title FROM p"""
)
def sf_file_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pdf_clips", "path", "source").distinct()
    return rows.select("path", T.file_name(F.col("path")).alias("name"), T.bare_title(T.file_name(F.col("path"))).alias("bare"), T.title_of_file(F.col("source")).alias("file_title"))


@query(
    r"""WITH b AS (SELECT DISTINCT clip_id, md FROM clippings WHERE md IS NOT NULL),
c AS (SELECT clip_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '\r\n', chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body FROM b)
SELECT clip_id, sha256(body) AS hash, length(body) AS n_chars FROM c"""
)
def sf_canonical_hash(spark: SparkSession, d: str) -> DataFrame:
    body = T.canonical_body(F.col("md"))
    rows = table(spark, d, "clippings", "clip_id", "md").filter("md is not null").distinct()
    return rows.select("clip_id", F.sha2(body, 256).alias("hash"), F.length(body).alias("n_chars"))


@query(
    f"""WITH {_CLIPS} SELECT clip_id, '---' || chr(10) || 'title: ' || '"' || replace(replace(title, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"'
  || coalesce(chr(10) || 'source: ' || '"' || source || '"', '') || coalesce(chr(10) || 'created: ' || strftime(created, '%Y-%m-%d'), '')
  || coalesce(chr(10) || 'topic: ' || topic, '') || coalesce(chr(10) || 'source-hash: ' || lower(trim(source_hash)), '') || chr(10) || '---' || chr(10) AS frontmatter
FROM clips WHERE title IS NOT NULL"""
)
def sf_clip_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "clippings", "clip_id", "title", "source", "created", "topic", "source_hash").filter("title is not null").distinct()
    fields = {
        "title": T.quoted_yaml(F.col("title")), "source": F.concat(F.lit('"'), F.col("source"), F.lit('"')), "created": F.date_format("created", "yyyy-MM-dd"),
        "topic": F.col("topic"), "source-hash": F.lower(F.trim("source_hash")),
    }
    return rows.select("clip_id", T.clip_frontmatter(fields).alias("frontmatter"))


_MATCH = (
    r"regexp_replace(lower(regexp_replace(replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace({0}, 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), "
    r"'-[ \t]*\r?\n[ \t]*', '', 'g'), '[''‘’\"“”*_`—–-]', '', 'g'), '…', '...'), '\s+', ' ', 'g')), '^\s+|\s+$', '', 'g')"
)


def sql_matching(c: str) -> str:
    """SQL of the form of text that quotations are looked up in."""
    return _MATCH.replace("{0}", c)


@query(f"WITH {DOCS} SELECT doc_id, sha256({sql_matching('text')}) AS form FROM docs WHERE text IS NOT NULL")
def sf_matching_form(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d, "text").filter("text is not null").select("doc_id", F.sha2(T.matching_form(F.col("text")), 256).alias("form"))


@query(
    rf"""WITH {DOCS}, q AS (SELECT doc_id, unnest(list_concat(regexp_extract_all({_BODY}, '“([^“”]+?)”', 1), regexp_extract_all(regexp_replace({_BODY}, '“([^“”]+?)”', ' ', 'g'), '"([^"]*?)"', 1))) AS quote
  FROM docs WHERE text IS NOT NULL)
SELECT doc_id, quote, count(*) AS n FROM q WHERE len(regexp_extract_all(quote, '\S+')) >= 5 GROUP BY ALL"""
)
def ln_quoted_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d, "text").filter("text is not null").select("doc_id", F.explode(T.quoted_spans(T.body(F.col("text")))).alias("quote"))
    return rows.groupBy("doc_id", "quote").agg(F.count("*").alias("n"))


#: Wording checked in the synthetic text, whose vocabulary the default lexicon doesn't meet.
_LEXICON = {"puffery": ["legendary", "world-class", "long-term", "self-contained"], "weasel": ["many people", "without any ceremony", "with little warning"], "doubt": ["so-called", "second-hand"]}
_APPLIES = {"wiki/entities/": ["puffery", "weasel", "doubt"], "wiki/concepts/": ["weasel"], "wiki/sources/": ["weasel"]}


def _style_sql() -> str:
    rows = [(c, w, f, lint.word_pattern(w)) for c, ws in _LEXICON.items() for w in ws for f, kinds in _APPLIES.items() if c in kinds]
    values = ", ".join(f"('{c}', '{w}', '{f}', '{p}')" for c, w, f, p in rows)
    return f"""WITH x(category, word, folder, pattern) AS (VALUES {values}),
b AS (SELECT DISTINCT chunk_id, path, regexp_replace(text, '["“][^"“”]*["”]', '""', 'g') AS body FROM chunks WHERE text IS NOT NULL)
SELECT DISTINCT chunk_id, category, word FROM b JOIN x ON starts_with(b.path, x.folder) AND regexp_matches(b.body, x.pattern)"""


@query(_style_sql())
def ln_style_flags(spark: SparkSession, d: str) -> DataFrame:
    return lint.style(table(spark, d, "chunks", "chunk_id", "path", "text"), "chunk_id", "path", "text", _LEXICON, _APPLIES)


@query(
    r"""WITH s AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE starts_with(path, 'wiki/syntheses/') AND text IS NOT NULL),
e AS (SELECT chunk_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS x FROM s)
SELECT DISTINCT chunk_id, left(regexp_replace(x, '^\s+|\s+$', '', 'g'), 70) AS sentence FROM e WHERE regexp_matches(x, '(?i)\b(however|but|despite|yet)\b') AND NOT contains(x, '[[')"""
)
def ln_connectives(spark: SparkSession, d: str) -> DataFrame:
    return lint.connectives(table(spark, d, "chunks", "chunk_id", "path", "text").distinct(), "chunk_id", "path", "text").distinct()


@query(
    rf"""WITH {DOCS}, f AS (SELECT doc_id, text, {_FM} AS fm FROM docs WHERE text IS NOT NULL)
SELECT doc_id, sha256(CASE WHEN fm = '' OR regexp_matches(fm, '(?m)^source-hash:') THEN text
  ELSE '---' || chr(10) || fm || chr(10) || 'source-hash: ' || sha256(text) || chr(10) || '---' || substr(text, length(regexp_extract(text, '(?s)^---\r?\n(.*?)\r?\n---', 0)) + 1) END) AS rewritten FROM f"""
)
def rp_add_source_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d, "text").filter("text is not null")
    return rows.select("doc_id", F.sha2(repair.with_source_hash(F.col("text"), F.sha2("text", 256)), 256).alias("rewritten"))


@query()
def vx_chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d, "text").withColumn("title", F.regexp_extract("text", r"(?m)^# +(.*?)[ \t\r]*$", 1))
    return chunking.chunk_documents(rows, "doc_id", "title", "text")


@query()
def rp_merge_sources(spark: SparkSession, d: str) -> DataFrame:
    """Every document records the first link of its text among its sources."""
    rows = documents(spark, d, "text").withColumn("add", F.transform(F.slice(T.wikilinks(T.body(F.col("text"))), 1, 1), lambda t: F.concat(F.lit("[["), t, F.lit("]]"))))
    return repair.merge_frontmatter_list(rows, "doc_id", "text", "add", "sources").select("doc_id", T.wikilinks(T.frontmatter(F.col("text"))).alias("sources"))


@query(
    r"""WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY loaded_at DESC) AS nth FROM wiki_pages) WHERE nth = 1)
SELECT p.path, CAST(coalesce(words, 0) AS BIGINT) AS words, (ends_with(p.path, '.md') AND NOT regexp_matches(p.path, '^(_templates|raw|log)/') AND p.path NOT IN ('index.md', 'log.md', 'vault-schema.md')) AS content,
  regexp_matches(p.path, '^(raw|wiki/sources)/') AS evidence, regexp_matches(p.path, '^(wiki/syntheses|moc)/') AS root, (coalesce(page_status = 'stub', false) OR coalesce(words, 0) < 10) AS stub FROM p"""
)
def pf_page_predicates(spark: SparkSession, d: str) -> DataFrame:
    from gleanery.operators import vault as V

    p = F.col("path")
    rows = pages(spark, d).filter("type <> 'clip'")
    return rows.select("path", F.coalesce("words", F.lit(0)).cast("bigint").alias("words"), V.is_content(p).alias("content"), V.is_evidence(p).alias("evidence"), V.is_root(p).alias("root"), V.is_stub(F.col("status"), F.col("words")).alias("stub"))
