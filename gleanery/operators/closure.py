"""Closure of a topic over the link graph, what it touches, and reconciling past removals with what is there now."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.vault import is_structural
from gleanery.session import shared_dir, stored


def closure(referrers: DataFrame, seeds: DataFrame) -> DataFrame:
    """``path, round``: the least set with the seeds in which every page is taken whose referrers (at least one, structural
    pages not counted) are all taken; structural pages are taken only as seeds. referrers: ``path, referrer``, distinct.

    Semi-naive: a round only looks at pages that the pages taken in the round before refer to, and counts how many of their
    referrers have been taken, so the work per round follows what is new. Each round is appended to a table in the shared folder; it ends when a round
    takes nothing, however many there are."""
    live = referrers.filter(~is_structural(F.col("referrer")))
    need = stored(live.filter(~is_structural(F.col("path"))).groupBy("path").agg(F.count("*").alias("need")), "need")
    edges = stored(live, "edges")
    spark = referrers.sparkSession
    folder, schema, n = f"{shared_dir(spark)}/taken-{uuid.uuid4().hex}", "path string, round int", 0

    def rounds() -> DataFrame:
        return spark.read.schema(schema).parquet(folder)

    seeds.select("path").distinct().withColumn("round", F.lit(0)).write.parquet(folder)
    taken = new = rounds()
    while not new.isEmpty():
        n += 1
        near = edges.join(new.select(F.col("path").alias("referrer")), "referrer", "left_semi").select("path").distinct()
        got = edges.join(near, "path", "left_semi").join(taken.select(F.col("path").alias("referrer")), "referrer", "left_semi").groupBy("path").agg(F.count("*").alias("got"))
        fresh = got.join(need, "path").filter("got = need").join(taken, "path", "left_anti").select("path", F.lit(n).alias("round"))
        fresh.write.mode("append").parquet(folder)
        taken = rounds()
        new = taken.filter(F.col("round") == n)
    return taken


def collateral(referrers: DataFrame, taken: DataFrame) -> DataFrame:
    """``path, n``: surviving pages with links into the set, and how many."""
    hit = referrers.join(taken.select("path"), "path", "left_semi")
    return hit.join(taken.select(F.col("path").alias("referrer")), "referrer", "left_anti").groupBy(F.col("referrer").alias("path")).agg(F.count("*").alias("n"))


def blocking(resolved: DataFrame, taken: DataFrame) -> DataFrame:
    """Surviving pages that would lose all their resolved citations."""
    cites = resolved.filter("channel = 'prov' and resolved is not null").select(F.col("source").alias("path"), F.col("resolved").alias("cited")).distinct()
    gone = taken.select(F.col("path").alias("cited"), F.lit(True).alias("gone"))
    rows = cites.join(gone, "cited", "left").groupBy("path").agg(F.bool_and(F.coalesce("gone", F.lit(False))).alias("lost")).filter("lost").select("path")
    return rows.join(taken.select("path"), "path", "left_anti")


def reconcile(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """``path, purge_id, reason``: files that are there again after a removal, each claimed once, by the earliest removal: the
    one that removed its path, or, where nothing of the path is left to claim, one that removed its content.

    entries: ``purge_id, entry, from_path, source_hash``. pages: ``path, source_hash``. An entry takes its path if no earlier
    entry did; an entry that finds its path missing or taken claims all files of its hash that are still free."""
    order = F.struct("purge_id", "entry")
    e = entries.select("purge_id", "entry", "from_path", F.lower("source_hash").alias("h"))
    by_path = e.join(pages.select(F.col("path").alias("from_path")), "from_path").groupBy("from_path").agg(F.min(order).alias("o"))
    # claims by path come from the first entry of each path; all other entries fall through to the hash
    falls = e.join(by_path, "from_path", "left").filter(F.col("o").isNull() | (F.col("o") != order)).filter("h is not null and h <> ''")
    first_hash = falls.groupBy("h").agg(F.min(order).alias("o"))
    by_hash = pages.filter("source_hash is not null").select("path", F.lower("source_hash").alias("h")).join(first_hash, "h").select("path", F.col("o"), F.lit("source-hash").alias("reason"))
    claims = by_path.select(F.col("from_path").alias("path"), "o", F.lit("path").alias("reason")).unionByName(by_hash)
    best = claims.groupBy("path").agg(F.min(F.struct("o", "reason")).alias("c"))
    return best.select("path", F.col("c.o.purge_id").alias("purge_id"), F.col("c.reason").alias("reason"))


def restore_plan(entries: DataFrame, live: DataFrame) -> DataFrame:
    """``from_path, action``: put back what is missing, skip what is there; one row per path."""
    rows = entries.select("from_path").filter("from_path is not null").distinct().join(live.select(F.col("path").alias("from_path"), F.lit(True).alias("there")).distinct(), "from_path", "left")
    return rows.select("from_path", F.when(F.col("there"), "skip").otherwise("restore").alias("action"))


def bin_paths(entries: DataFrame) -> DataFrame:
    """``purge_id, from_path, bin_path``: where removed files are kept; a second file of one name gets a number."""
    place = F.row_number().over(Window.partitionBy("purge_id", "from_path").orderBy("entry"))
    base = F.concat(F.lit(".recycle/"), F.col("purge_id"), F.lit("/"), F.col("from_path"))
    return entries.withColumn("n", place).select("purge_id", "from_path", F.when(F.col("n") == 1, base).otherwise(F.concat(base, F.lit("-resurrected-"), F.col("n") - 1)).alias("bin_path"))
