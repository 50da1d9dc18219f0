"""Catalogs: pages grouped under headings in a given order, freshness, backlogs, demand for missing pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.vault import is_content

#: Sections of the index in the order shown, by page type.
SECTIONS = ["synthesis", "authored", "moc", "concept", "source", "entity"]
#: Kinds of authored pages and states of a backlog in the order shown.
KINDS = ["overview", "architecture", "reference", "guide", "diagram", "decision", "roadmap", "note"]
BACKLOG = ["in-progress", "planned", "blocked", "shipped", "dropped"]
#: Limits of age in days.
FRESH = [(30, "fresh"), (90, "aging"), (180, "stale")]


def ordinal(value: Column, order: list[str]) -> Column:
    """Place of a value in a vocabulary, after all others if it isn't in it."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), value)
    return F.when(value.isNull() | (at == 0), F.lit(len(order) + 1)).otherwise(at)


def catalog(pages: DataFrame, order: list[str] | None = None) -> DataFrame:
    """``section, place, path, entry``: content pages as lines of links, declared stubs marked, items of a backlog left out (where
    pages have a ``kind``); in order of place and path they are the catalog, sections of other types last. A row per page, so a
    section may be of any size."""
    order = order or SECTIONS
    rows = pages.filter(is_content(F.col("path")))
    if "kind" in pages.columns:
        rows = rows.filter(F.coalesce(F.col("kind") != "backlog-item", F.lit(True)))
    section = F.when(F.col("type").isin(order), F.col("type")).otherwise("other")
    line = F.concat(F.lit("- [["), F.col("name"), F.lit("]]"), F.when(F.col("status") == "stub", " (stub)").otherwise(""))
    return rows.select(section.alias("section"), ordinal(section, order).cast("int").alias("place"), "path", line.alias("entry"))


def groups(df: DataFrame, key: Column, label: Column, order: str, least: int = 1) -> DataFrame:
    """``key, label, n``: groups of at least ``least`` rows under their first spelling; null keys are dropped."""
    return df.groupBy(key.alias("key")).agg(F.min_by(label, order).alias("label"), F.count("*").alias("n")).filter((F.col("n") >= least) & F.col("key").isNotNull())


def vocabulary_groups(df: DataFrame, value: str, order: list[str], keep_other: bool) -> DataFrame:
    """``value, place, n`` in the order of a vocabulary; other values together last, or dropped."""
    known = F.col(value).isin(order)
    v = F.when(known, F.col(value)).otherwise("other")
    rows = df if keep_other else df.filter(known)
    return rows.groupBy(v.alias("value")).agg(F.count("*").alias("n")).select("value", ordinal(F.col("value"), order).cast("int").alias("place"), "n")


def freshness(df: DataFrame, key: str, reviewed: str, updated: str, today: str) -> DataFrame:
    """``key, age_days, bucket``: days since the later date; rotten beyond all limits or without any date."""
    age = F.datediff(F.lit(today).cast("date"), F.greatest(F.col(reviewed).cast("date"), F.col(updated).cast("date")))
    bucket = F.lit("rotten")
    for limit, name in reversed(FRESH):
        bucket = F.when(age < limit, name).otherwise(bucket)
    return df.select(key, age.alias("age_days"), bucket.alias("bucket"))


def overdue(df: DataFrame, folder: str, path: str, reviewed: str, today: str, days: int = 90) -> DataFrame:
    """The saved view of pages below a folder that were reviewed more than ``days`` ago."""
    return df.filter(F.col(path).startswith(folder + "/") & (F.col(reviewed) < F.date_sub(F.lit(today).cast("date"), days)))


def wanted_pages(broken: DataFrame, least: int = 3) -> DataFrame:
    """``target, refs``: missing pages asked for at least ``least`` times."""
    return broken.groupBy("target").agg(F.count("*").alias("refs")).filter(F.col("refs") >= least)
