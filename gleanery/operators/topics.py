"""Topics: attribution of items by URL or path, and groups in the order they are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import topic_key, topic_label
from gleanery.functions.urls import url_key


def topic_index(clips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics by URL and by path of clips ``path, source, topic``; of several the one of the last path counts."""
    known = clips.select("path", "source", topic_label(F.col("topic")).alias("topic")).filter("topic is not null")
    by_url = known.filter("source is not null").groupBy(url_key(F.col("source")).alias("url_key")).agg(F.max_by("topic", "path").alias("url_topic"))
    by_path = known.groupBy(F.lower(F.trim("path")).alias("path_key")).agg(F.max_by("topic", "path").alias("path_topic"))
    return by_url, by_path


def attribute(items: DataFrame, clips: DataFrame) -> DataFrame:
    """``items`` (with ``url, path, topic``) and ``attributed``: their own topic, else by URL, else by path, else null."""
    by_url, by_path = topic_index(clips)
    rows = items.withColumn("url_key", url_key(F.col("url"))).withColumn("path_key", F.lower(F.trim("path")))
    rows = rows.join(by_url, "url_key", "left").join(by_path, "path_key", "left")
    return rows.withColumn("attributed", F.coalesce(topic_label(F.col("topic")), "url_topic", "path_topic")).drop("url_key", "path_key", "url_topic", "path_topic")


def topic_groups(items: DataFrame, topic: str, order: str) -> DataFrame:
    """``topic_key, label, n, place``: label is the first spelling by ``order``; larger groups first, then by key; items
    without a topic last, only if there are any."""
    groups = items.groupBy(topic_key(F.col(topic)).alias("topic_key")).agg(F.min_by(topic_label(F.col(topic)), order).alias("label"), F.count("*").alias("n"))
    rank = F.struct(F.col("topic_key").isNull().alias("a"), (-F.col("n")).alias("b"), F.col("topic_key").alias("c"))
    # places by counting what comes before; groups are few against items, and the sort is global
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(rank))
    return groups.select(F.coalesce("topic_key", F.lit("")).alias("topic_key"), F.coalesce("label", F.lit("Unattributed")).alias("label"), "n", place.alias("place"))
