"""The vault as DataFrames: pages of all kinds under one schema, and their links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.sources.tables import latest, table

SYSTEM_FILES = ["index.md", "log.md", "vault-schema.md"]


def is_content(path: Column) -> Column:
    """Markdown that is neither a system file, a template, a raw source nor a log entry."""
    return path.endswith(".md") & ~path.isin(SYSTEM_FILES) & ~path.rlike("^(_templates|raw|log)/")


def is_evidence(path: Column) -> Column:
    return path.rlike("^(raw|wiki/sources)/")


def is_structural(path: Column) -> Column:
    return path.isin(SYSTEM_FILES) | path.rlike("^(moc|log|_templates)/")


def is_root(path: Column) -> Column:
    return path.rlike("^(wiki/syntheses|moc)/")


def is_stub(status: Column, words: Column) -> Column:
    return F.coalesce(status == "stub", F.lit(False)) | (F.coalesce(words, F.lit(0)) < 10)


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Wiki pages and clips: ``path, name, title, status, type, words, created, updated, topic, source, source_hash, source_hashes,
    declares_no_sources``. An empty array of sources declares that there are none; a null one says nothing."""
    wiki = latest(table(spark, d, "wiki_pages"), "page_id").select(
        "path", F.lower(T.file_name(F.col("path"))).alias("name"), "title", F.col("page_status").alias("status"), F.col("page_type").alias("type"), "words", "created",
        F.to_date("updated_at").alias("updated"), "topic", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("source_hash"),
        F.transform("source_hashes", lambda h: F.lower(F.trim(h))).alias("source_hashes"), F.coalesce(F.size("sources") == 0, F.lit(False)).alias("declares_no_sources"),
    )

    def clips(name: str) -> DataFrame:
        return latest(table(spark, d, name, "clip_id", "path", "title", "source", "topic", "created", "source_hash", "md", "loaded_at"), "clip_id", ties=[F.lit(0)]).select(
            "path", F.lower(T.file_name(F.col("path"))).alias("name"), "title", F.lit(None).cast("string").alias("status"), F.lit("clip").alias("type"),
            T.word_count(F.coalesce("md", F.lit(""))).cast("int").alias("words"), "created", F.col("created").alias("updated"), "topic", "source",
            F.nullif(F.lower(F.trim("source_hash")), F.lit("")).alias("source_hash"), F.lit(None).cast("array<string>").alias("source_hashes"), F.lit(False).alias("declares_no_sources"),
        )

    return wiki.unionByName(clips("clippings")).unionByName(clips("pdf_clips"))


def links(spark: SparkSession, d: str) -> DataFrame:
    """``source, pos, channel, target``: citations in frontmatter (prov) and links in the text (nav), in order, repeats kept."""
    wiki = latest(table(spark, d, "wiki_pages", "page_id", "path", "sources", "loaded_at"), "page_id")
    prov = wiki.select(F.col("path").alias("source"), F.posexplode("sources").alias("pos", "entry"))
    prov = prov.select("source", F.col("pos").cast("bigint").alias("pos"), F.lit("prov").alias("channel"), F.get(T.wikilinks(F.col("entry")), 0).alias("target")).filter("target is not null")
    body = latest(table(spark, d, "chunks", "chunk_id", "path", "text", "loaded_at").filter(F.col("text").contains("[[")), "chunk_id")
    nav = body.select(F.col("path").alias("source"), F.posexplode(T.wikilinks(F.col("text"))).alias("pos", "target"), "chunk_id")
    return prov.unionByName(nav.select("source", F.shiftleft("chunk_id", 20).bitwiseOR(F.col("pos")).alias("pos"), F.lit("nav").alias("channel"), "target"))
