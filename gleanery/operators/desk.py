"""The working desk: queues by topic, candidates for capture, covers and citers, classes by rules, notices and tiers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import topic_key
from gleanery.functions.urls import url_key
from gleanery.operators.capture import blocked

BINARY = r"(?i)\.(pdf|docx|xlsx|pptx|epub|zip|png|jpe?g)$"


def covers(resolved: DataFrame) -> DataFrame:
    """``path, cover``: of each clip the first source page that cites it."""
    rows = resolved.filter(F.col("source").startswith("wiki/sources/") & F.col("resolved").startswith("raw/"))
    return rows.groupBy(F.col("resolved").alias("path")).agg(F.min("source").alias("cover"))


def binary_citers(broken: DataFrame) -> DataFrame:
    """``target, n, first_source``: broken links to files that aren't text, by target."""
    return broken.filter(F.col("target").rlike(BINARY)).groupBy("target").agg(F.count("*").alias("n"), F.min("source").alias("first_source"))


def candidates(found: DataFrame, known: DataFrame, blocklist: DataFrame, declined: DataFrame) -> DataFrame:
    """``url_key, url`` of what may be captured: each URL once (its first spelling), not known, not blocked, not declined.
    found and known: ``url``; declined: ``url_key``."""
    rows = found.filter("url is not null").groupBy(url_key(F.col("url")).alias("url_key")).agg(F.min("url").alias("url"))
    rows = rows.join(known.select(url_key(F.col("url")).alias("url_key")).filter("url_key is not null").distinct(), "url_key", "left_anti")
    return blocked(rows, "url", blocklist).filter("not is_blocked").drop("is_blocked").join(declined.select("url_key"), "url_key", "left_anti")


def queue(items: DataFrame, topic: str, group: str, chosen: str = "*") -> DataFrame:
    """``group, n``: items of a topic key (``*`` all, empty those without a topic) per group; empty groups don't show."""
    key = topic_key(F.col(topic))
    rows = items if chosen == "*" else items.filter(key.isNull() if chosen == "" else key == chosen)
    return rows.groupBy(group).agg(F.count("*").alias("n"))


def classify(df: DataFrame, column: str, rules: list[tuple[str, str]], default: str | None = None):
    """Column of the class of the first pattern that matches."""
    out = F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(F.coalesce(df[column].rlike(pattern), F.lit(False)), name).otherwise(out)
    return out


def enriched(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Purge entries with the web address of what was removed, where it had one. pages: ``path, source``."""
    urls = pages.filter(F.col("source").rlike("(?i)^https?://")).groupBy(F.col("path").alias("from_path")).agg(F.min("source").alias("url"))
    return entries.join(urls, "from_path", "left")


def holds_path(binaries: DataFrame, clips: DataFrame, head: int = 600) -> DataFrame:
    """``path, clip``: the first clip whose head names the binary's file. binaries: ``path``; clips: ``path, md``.

    File names are cut out of the heads by a pattern and joined, instead of looking for every name in every head."""
    name = r"[^\s/\\\"'()\[\]<>|]+\.(?:pdf|docx|xlsx|pptx|epub|zip)"
    told = clips.select(F.col("path").alias("clip"), F.explode(F.array_distinct(F.regexp_extract_all(F.left("md", F.lit(head)), F.lit("(?i)" + name), F.lit(0)))).alias("name"))
    wanted = binaries.select("path", F.regexp_extract("path", r"([^/\\]+)$", 1).alias("name"))
    return wanted.join(told, "name").groupBy("path").agg(F.min("clip").alias("clip"))


def should_announce(last: dt.datetime | None, now: dt.datetime, hours: float = 4) -> bool:
    """Whether a full notice is due."""
    return last is None or (now - last).total_seconds() >= hours * 3600


def tier(provider: bool, indexed: int, missing: int) -> tuple[str, list[str]]:
    """What search can do, and what is lacking for more."""
    gaps = [name for name, bad in (("no provider of embeddings", not provider), ("no index", indexed == 0), (f"{missing} chunks without a vector", indexed > 0 and missing > 0)) if bad]
    return ("hybrid" if provider and indexed else "lexical"), gaps
