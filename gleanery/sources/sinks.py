"""Writing: versioned tables with an atomic switch, event logs, clips as files, upserts of small stores."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of issues an event log may hold.
ISSUE_KINDS = ["failed", "thin", "wrong-node", "blocked", "fidelity", "attention"]


def _files(spark: SparkSession, root: str):
    """The file system of a folder, by its own scheme, and the class of its paths."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.FileContext.getFileContext(hadoop.Path(root).toUri(), spark._jsc.hadoopConfiguration()), hadoop.Path


def publish(df: DataFrame, root: str, name: str) -> str:
    """Writes ``df`` as a new version and then switches the pointer file to it; readers see the old or the new one, never half.
    The folder may be on any file system that Spark writes to; the switch is its rename."""
    spark, version = df.sparkSession, f"{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    files, path = _files(spark, root)
    base = files.makeQualified(path(root))
    temporary, pointer = path(base, f".{name}.{uuid.uuid4().hex}"), path(base, f"{name}.json")
    fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(base.toUri(), spark._jsc.hadoopConfiguration())
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps({"version": version}).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(temporary, pointer, options)
    return version


def published(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The current version, or None if there is none."""
    files, path = _files(spark, root)
    pointer = path(files.makeQualified(path(root)), f"{name}.json")
    if not files.util().exists(pointer):
        return None
    said = "".join(r[0] for r in spark.read.text(pointer.toString()).collect())  # one line
    return spark.read.parquet(f"{root}/{json.loads(said)['version']}")


def append_events(df: DataFrame, path: str, kinds: list[str] | None = None) -> None:
    """Appends events as lines of JSON; an unknown ``kind`` fails the whole batch, so a batch is taken whole or not at all."""
    allowed = F.array(*[F.lit(k) for k in kinds or ISSUE_KINDS])
    checked = df.withColumn("kind", F.when(F.array_contains(allowed, F.col("kind")), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind: "), F.coalesce("kind", F.lit("null")))).cast("string")))
    checked.write.mode("append").json(path)


def upserted(store: DataFrame, new: DataFrame, key) -> DataFrame:
    """A store with the rows of ``new`` in place of those of equal key. key: function from the frame to the column compared."""
    old = store.withColumn("__k", key(store))
    fresh = new.withColumn("__k", key(new))
    return old.join(fresh.select("__k"), "__k", "left_anti").unionByName(fresh).drop("__k")


def removed(store: DataFrame, gone: DataFrame, key, also: list[str]) -> DataFrame:
    """A store without the rows whose key and further columns equal those of ``gone``."""
    return store.withColumn("__k", key(store)).join(gone.withColumn("__k", key(gone)).select("__k", *also), ["__k", *also], "left_anti").select(*store.columns)


def write_texts(df: DataFrame, path: str, text: str = "text") -> None:
    """One text per row into files of lines, partitioned by nothing; line ends inside a text are kept."""
    df.select(text).write.mode("overwrite").option("lineSep", "\n").text(path)
