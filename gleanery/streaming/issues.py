"""Open issues as a stream: the fold of ``operators.events`` kept up to date as events arrive, in file order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.events import open_issues


def fold_state(state: DataFrame | None, batch: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Per key the last disposition and the issues since: state of ``keys, closed, first_seq, first_seen, last_seq, last_seen,
    occurrences``. A batch is folded first and then merged with the state, so only one row per key is shuffled."""
    closed = batch.filter("is_disposition").groupBy(*keys).agg(F.max("seq").alias("closed"))
    base = closed if state is None else state.select(*keys, "closed").unionByName(closed).groupBy(*keys).agg(F.max("closed").alias("closed"))
    new = open_issues(batch, keys, at, [], []).join(batch.filter("is_issue").groupBy(*keys).agg(F.max("seq").alias("last_seq")), keys)
    new = new.select(*keys, "first_seen", "last_seen", "last_seq", "occurrences")
    if state is not None:
        keep = state.filter("occurrences > 0").join(closed.withColumnRenamed("closed", "c"), keys, "left").filter("c is null").drop("c")
        new = keep.select(*keys, "first_seen", "last_seen", "last_seq", "occurrences").unionByName(new)
        new = new.groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max_by("last_seen", "last_seq").alias("last_seen"), F.max("last_seq").alias("last_seq"), F.sum("occurrences").alias("occurrences"))
    return base.join(new, keys, "full_outer").fillna({"occurrences": 0})


def run(stream: DataFrame, keys: list[str], at: str, folder: str, publish: Callable[[DataFrame], None] | None = None) -> None:
    """Folds a stream batch by batch into versions of the state below ``folder``; returns when what is there is used up.

    The version of a batch is named by its number, so a batch that is repeated after a failure overwrites its own version."""
    spark = stream.sparkSession

    def each(batch: DataFrame, n: int) -> None:
        old = spark.read.parquet(f"{folder}/state-{n - 1}") if n else None
        fold_state(old, batch, keys, at).write.mode("overwrite").parquet(f"{folder}/state-{n}")
        if publish:
            publish(spark.read.parquet(f"{folder}/state-{n}"))

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()


def suppressed(stream: DataFrame, key: str, at: str, hours: int = 4) -> DataFrame:
    """A stream with at most one notice per key within ``hours``."""
    return stream.withWatermark(at, f"{hours} hours").dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and value, later events than ``late`` dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))
