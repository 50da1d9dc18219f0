"""Problem 2: references to records that do not exist.

Parent keys and child keys go into one long form ``(key_kind, key, at, is_parent)``; a group by kind and key finds when the
key's first usable parent appeared, and references whose key has no parent by their own time are orphans.

Scale. Both aggregations combine before the shuffle, so a key that a third of all references share arrives as one row per
input split. The flag returns to the references by a join on the key; references to keys that hold more than one part in
``HOT_PARTS`` of all references (of which there can be fewer than ``HOT_PARTS`` keys, a proven bound) take a broadcast join
instead, so that no task receives an unbounded group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.session import stored

#: A key is hot if more than one reference in this many uses it: fewer keys than this can be hot.
HOT_PARTS = 1000


def _blank(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def wikilink_name(link: Column) -> Column:
    """The clip name a wikilink refers to: last part of the target, without brackets (and quotes around them), alias,
    heading, ``.md`` and outer blanks. A text without brackets is taken as a target itself."""
    bracketed = F.regexp_extract(link, r"(?s)\[\[(.*?)\]\]", 1)
    inner = F.when(F.instr(link, "[[") > 0, bracketed).otherwise(link)
    target = _blank(F.regexp_extract(inner, r"(?s)^([^|#]*)", 1))
    return _blank(F.regexp_replace(_blank(F.regexp_extract(target, r"(?s)([^/]*)$", 1)), r"\.md$", ""))


def path_name(path: Column) -> Column:
    """File name of a path without folder and ``.md``."""
    return F.regexp_replace(F.regexp_extract(path, r"(?s)([^/]*)$", 1), r"\.md$", "")


def hash_key(value: Column) -> Column:
    """A content hash as compared: lower case, without outer blanks."""
    return F.lower(_blank(value))


def reference_entries(pages: DataFrame) -> DataFrame:
    """Every entry of ``sources`` and ``source_hashes`` that is neither null nor blank:
    ``(page_id, field, pos, updated_at, kind, key)``. Null and empty arrays give no rows; repeated page rows give one."""

    def side(field: str) -> Column:
        entries = F.coalesce(F.col(field), F.array().cast("array<string>"))
        return F.transform(entries, lambda x, i: F.struct(F.lit(field).alias("field"), (i + 1).cast("int").alias("pos"), x.alias("entry")))

    # both fields in one pass over the pages
    rows = pages.select("page_id", "updated_at", F.explode(F.concat(side("sources"), side("source_hashes"))).alias("e")).select("page_id", "updated_at", "e.*")
    rows = rows.filter(F.col("entry").isNotNull() & (_blank(F.col("entry")) != ""))
    named = F.col("field") == "sources"
    key = F.when(named, wikilink_name(F.col("entry"))).otherwise(hash_key(F.col("entry")))
    return rows.select("page_id", "field", "pos", "updated_at", F.when(named, "name").otherwise("hash").alias("kind"), key.alias("key"))


def usable_clips(clippings: DataFrame, pdf_clips: DataFrame, purges: DataFrame) -> DataFrame:
    """Parents in long form ``(kind, key, at)``: names and hashes of the clips whose path no purge holds removed."""
    cols = ["path", "captured_at", "source_hash"]
    clips = clippings.select(*cols).unionByName(pdf_clips.select(*cols))
    gone = purges.filter(F.col("restored_at").isNull() & F.col("from_path").isNotNull()).select(F.col("from_path").alias("path")).distinct()
    kept = clips.join(gone, "path", "left_anti")
    names = kept.select(F.lit("name").alias("kind"), path_name(F.col("path")).alias("key"), F.col("captured_at").alias("at"))
    hashes = kept.select(F.lit("hash").alias("kind"), hash_key(F.col("source_hash")).alias("key"), F.col("captured_at").alias("at"))
    return names.unionByName(hashes).filter(F.col("key").isNotNull() & (F.col("key") != "") & F.col("at").isNotNull())


def orphans(entries: DataFrame, parents: DataFrame) -> DataFrame:
    """The entries without a parent at their own time, with all their columns and ``first_parent_at`` (null: none ever).

    entries: ``kind, key, updated_at`` and any other columns. parents: ``kind, key, at``. A null ``updated_at`` has no
    usable parent, as nothing can be shown to precede it. Repeated entries stay repeated."""
    long = entries.select("kind", "key", F.lit(0).alias("is_parent"), F.lit(None).cast("timestamp_ntz" if dict(parents.dtypes)["at"] == "timestamp_ntz" else "timestamp").alias("at")).unionByName(
        parents.select("kind", "key", F.lit(1).alias("is_parent"), "at")
    )
    # read for the total, the hot keys and the join: kept in the shared folder, a row per key
    keys = stored(
        long.groupBy("kind", "key")
        .agg(F.max("is_parent").alias("has_parent"), F.min("at").alias("first_parent_at"), F.sum(1 - F.col("is_parent")).alias("n_refs"))
        .filter("n_refs > 0"),
        "keys",
    )
    total = keys.agg(F.sum("n_refs").alias("n"))
    hot = keys.join(F.broadcast(total), F.col("n_refs") * HOT_PARTS > F.col("n")).select("kind", "key", "first_parent_at")
    hot = F.broadcast(hot.withColumn("hot", F.lit(True)))  # fewer than HOT_PARTS rows
    marked = entries.join(hot, ["kind", "key"], "left")
    cold = marked.filter(F.col("hot").isNull()).drop("hot", "first_parent_at").join(keys.select("kind", "key", "first_parent_at"), ["kind", "key"], "left")
    both = marked.filter(F.col("hot")).drop("hot").unionByName(cold)
    return both.filter(F.col("first_parent_at").isNull() | F.col("updated_at").isNull() | (F.col("first_parent_at") > F.col("updated_at")))


def orphan_report(entries: DataFrame, orphaned: DataFrame) -> DataFrame:
    """Counts per field and month of ``updated_at``: references, orphans, and of these the ones whose clip comes later."""
    month = F.date_format("updated_at", "yyyy-MM").alias("month")
    all_ = entries.groupBy("field", month).agg(F.count("*").alias("n_refs"))
    bad = orphaned.groupBy("field", month).agg(F.count("*").alias("n_orphans"), F.count("first_parent_at").alias("n_later"))
    joined = all_.alias("a").join(bad.alias("b"), (F.col("a.field") == F.col("b.field")) & F.col("a.month").eqNullSafe(F.col("b.month")), "left")
    return joined.select("a.field", "a.month", "n_refs", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"), F.coalesce("n_later", F.lit(0)).alias("n_later"))
