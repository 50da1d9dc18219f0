"""Event log: state folded from an append-only log in the order of ``seq``.

An event has ``key`` columns, ``seq``, ``is_issue`` and ``is_disposition`` and what it carries. A disposition closes all open
issues of its key, a later issue opens it again. One aggregation finds the last disposition per key and a window-free second
one folds what came after: both combine before the shuffle, so a key with a third of all events is no hot spot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _since_disposition(events: DataFrame, keys: list[str]) -> DataFrame:
    closed = events.filter("is_disposition").groupBy(*keys).agg(F.max("seq").alias("__closed"))
    return events.filter("is_issue").join(closed, keys, "left").filter(F.col("__closed").isNull() | (F.col("seq") > F.col("__closed"))).drop("__closed")


def open_issues(events: DataFrame, keys: list[str], at: str, latest: list[str], last_known: list[str]) -> DataFrame:
    """Open issues per key: ``first_seen, last_seen, occurrences``, of ``latest`` the value of the newest issue, of
    ``last_known`` the newest value that isn't null. Events with a null key are left out."""
    rows = _since_disposition(events.dropna(subset=keys), keys)
    return rows.groupBy(*keys).agg(
        F.min_by(at, "seq").alias("first_seen"), F.max_by(at, "seq").alias("last_seen"), F.count("*").alias("occurrences"),
        *[F.max_by(c, "seq").alias(c) for c in latest], *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in last_known],
    )


def settled(events: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose last event is a disposition."""
    return events.filter("is_issue or is_disposition").groupBy(*keys).agg(F.max_by("is_disposition", "seq").alias("s")).filter("s").drop("s")


def latest_disposition(events: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The newest disposition per key with ``columns`` of it."""
    return events.filter("is_disposition").groupBy(*keys).agg(F.max("seq").alias("seq"), *[F.max_by(c, "seq").alias(c) for c in columns])


def unexpired(declines: DataFrame, day: str, today: str, ttl: int = 180) -> DataFrame:
    """Declines not older than ``ttl`` days."""
    return declines.filter(F.datediff(F.lit(today).cast("date"), F.col(day)) <= ttl)


def nearing_expiry(declines: DataFrame, at: str, now: str, ttl: int = 180, window: int = 30) -> DataFrame:
    """Declines that end within ``window`` days, with the days that remain, rounded up."""
    seconds = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lit(now).cast("timestamp"))
    left: Column = F.ceil((seconds / F.lit(1e6) + F.lit(ttl * 86400.0)) / F.lit(86400.0)).cast("bigint")
    return declines.withColumn("days_left", left).filter((F.col("days_left") >= 0) & (F.col("days_left") <= window))


def without_settled(flagged: DataFrame, open_: DataFrame, closed: DataFrame, keys: list[str]) -> DataFrame:
    """Flagged records that are neither open nor settled already."""
    return flagged.join(open_.select(*keys), keys, "left_anti").join(closed.select(*keys), keys, "left_anti")
