"""Reading the project's Parquet tables and reducing redelivered rows to one version per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The table ``name`` below ``folder``; naming columns keeps the scan to them."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def latest(df: DataFrame, key: str | list[str], order: str = "loaded_at", ties: list[Column] | None = None) -> DataFrame:
    """One row per key: the one loaded last. Equal times are settled by ``ties`` (else by the hash of the whole row), so
    the result does not depend on the order of the input. Keys that are null are kept apart from each other as one group.

    Copies of one key number a handful, so the window per key stays small even if a *value* of another column is hot."""
    keys = [key] if isinstance(key, str) else key
    settle = ties if ties is not None else [F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")])]
    window = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), *settle)
    return df.withColumn("__nth", F.row_number().over(window)).filter("__nth = 1").drop("__nth")
