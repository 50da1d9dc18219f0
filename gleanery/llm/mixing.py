"""Problem 8: mixing sources to target weights.

Weighted fair queueing. Within a mix every document of a source has a place in a shuffled order (by a hash); its virtual
finish time is the source's cumulative tokens up to it, divided by the source's target weight. Another round of the same
source continues where the last one ended, up to ``max_repeats`` rounds. Sorting all copies by finish time and truncating at
the budget gives every source its share as long as its repeats last; beyond, the others keep their proportions.

Cumulative sums are made in two levels (buckets of the shuffled order, then within a bucket), so that no task holds a whole
source; a source with a third of all documents is spread like any other. Only ids and token counts are shuffled. What goes
through one task per mix is the table of sources (a row per row of ``mix_targets``).

Budget: the number of tokens per mix, by default the largest at which every source that has documents can still reach its
share of what those sources make up (the first source to use up its repeats sets it). A larger budget takes more and lets the
shares of used-up sources fall behind. Documents with no tokens (null or empty text) and of no listed source are not selected. Targets that are null or not above 0, and
``max_repeats`` below 1, select nothing; a null ``max_repeats`` counts as 1. Repeated rows of ``mix_targets`` (same mix and
source) count once, the largest share. Rows of one doc_id count once. A budget above what the repeats allow takes all.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of the shuffled order of one source, and of the finish times of one mix.
ORDER_BUCKETS = 4096
TIME_BUCKETS = 4096


def _levels(targets: pd.DataFrame) -> pd.DataFrame:
    """The virtual time at which one mix is full: the level at which sum(min(level x weight, capacity)) is the budget."""
    t = targets[targets["tokens"] > 0]
    left, level, weight, done = float(targets["budget"].iloc[0]), 0.0, t["weight"].sum(), 0.0
    for cap, w in sorted(zip(t["tokens"] * t["rounds"] / t["weight"], t["weight"])):
        step = (cap - done) * weight
        if step >= left:
            break
        left, done, weight = left - step, cap, weight - w
        level = cap
    if weight > 1e-12 and left > 0:
        level = done + left / weight
    return targets.assign(level=level)


def plan(sizes: DataFrame, targets: DataFrame, budget: int | str | None = None) -> DataFrame:
    """A row per mix and source: ``weight, rounds, tokens, n_docs, budget, level``. sizes: ``doc_id, source, n_tokens``.

    budget: tokens of a mix; "all": as many as all documents of its sources have, so that small sources are repeated, run
    out, and their shares fall behind; None: the most at which every source that has documents still reaches its share."""
    wanted = (
        targets.filter(F.col("mix_id").isNotNull() & F.col("source").isNotNull() & (F.col("target_share") > 0))
        .groupBy("mix_id", "source")
        .agg(F.max("target_share").alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("rounds"))
        .filter("rounds >= 1 and not isnan(weight)")
    )
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    rows = wanted.join(have, "source", "left").fillna({"tokens": 0, "n_docs": 0})
    mix, some = Window.partitionBy("mix_id"), F.col("tokens") > 0
    most = F.floor(F.min(F.when(some, F.col("tokens") * F.col("rounds") / F.col("weight"))).over(mix) * F.sum(F.when(some, F.col("weight"))).over(mix))
    given = F.coalesce(F.sum("tokens").over(mix) if budget == "all" else most, F.lit(0)).cast("double")
    total: Column = given if budget in (None, "all") else F.lit(float(budget))
    rows = rows.select("mix_id", "source", "weight", "rounds", "tokens", "n_docs", total.alias("budget"))
    schema = "mix_id string, source string, weight double, rounds int, tokens bigint, n_docs bigint, budget double, level double"
    return rows.groupBy("mix_id").applyInPandas(_levels, schema)


def select(sizes: DataFrame, planned: DataFrame) -> DataFrame:
    """``(mix_id, source, doc_id, copies, n_tokens, finish)``: the documents taken, how often, and the finish time of the first copy."""
    docs = sizes.select("doc_id", "source", "n_tokens").filter("n_tokens > 0").join(planned.filter("level > 0").drop("n_docs"), "source")
    shuffled = F.xxhash64("mix_id", "doc_id")
    docs = docs.withColumn("place", shuffled).withColumn("part", F.pmod(shuffled, F.lit(ORDER_BUCKETS)).cast("int"))
    sums = docs.groupBy("mix_id", "source", "part").agg(F.sum("n_tokens").alias("in_part"))
    before = Window.partitionBy("mix_id", "source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("mix_id", "source", "part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("mix_id", "source", "part").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = docs.withColumn("inside", F.sum("n_tokens").over(within)).join(offsets, ["mix_id", "source", "part"])
    first = (F.col("offset") + F.col("inside")) / F.col("weight")
    # only rounds that can end below the level are made; one document may end past it and still be the one that fills the budget
    last = F.col("level") * 1.001 + F.col("n_tokens") / F.col("weight")
    made = F.least(F.col("rounds"), F.floor((last - F.col("first")) / (F.col("tokens") / F.col("weight")) + 1).cast("int"))
    copies = (
        placed.withColumn("first", first)
        .withColumn("made", made)
        .filter("made >= 1")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("made"))))
        .withColumn("finish", F.col("first") + (F.col("copy") - 1) * (F.col("tokens") / F.col("weight")))
        .filter(F.col("finish") <= last)
        .withColumn("time", F.floor(F.col("finish") / F.col("level") * TIME_BUCKETS))
    )
    per_time = copies.groupBy("mix_id", "time").agg(F.sum("n_tokens").alias("in_time"))
    earlier = Window.partitionBy("mix_id").orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_time.select("mix_id", "time", F.coalesce(F.sum("in_time").over(earlier), F.lit(0)).alias("start"))
    run = Window.partitionBy("mix_id", "time").orderBy("finish", "source", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = copies.withColumn("run", F.sum("n_tokens").over(run)).join(starts, ["mix_id", "time"]).filter(F.col("start") + F.col("run") <= F.col("budget"))
    return taken.groupBy("mix_id", "source", "doc_id").agg(F.count("*").cast("int").alias("copies"), F.max("n_tokens").alias("n_tokens"), F.min("finish").alias("finish"))


def shares(selection: DataFrame, planned: DataFrame) -> DataFrame:
    """Per mix and source the target, the share reached, the tokens taken and available, and the most often one document is used."""
    got = selection.groupBy("mix_id", "source").agg(
        F.sum(F.col("copies") * F.col("n_tokens")).alias("taken_tokens"), F.count("*").alias("taken_docs"), F.max("copies").alias("most_copies")
    )
    rows = planned.join(got, ["mix_id", "source"], "left").fillna({"taken_tokens": 0, "taken_docs": 0, "most_copies": 0})
    mix = Window.partitionBy("mix_id")
    total = F.sum("taken_tokens").over(mix)
    return rows.select(
        "mix_id", "source", (F.col("weight") / F.sum("weight").over(mix)).alias("target_share"),
        F.when(total > 0, F.col("taken_tokens") / total).otherwise(F.lit(0.0)).alias("actual_share"),
        "taken_tokens", "taken_docs", "most_copies", F.col("rounds").alias("max_repeats"), F.col("tokens").alias("source_tokens"), "n_docs", F.col("budget").cast("bigint").alias("budget"),
        (F.col("taken_tokens") >= F.col("tokens") * F.col("rounds")).alias("used_up"),
    )
