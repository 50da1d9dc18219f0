"""Capturing documents: how faithful an extraction is, whether it is too thin, duplicates, blocked sites, and the plan of what
to keep. Thresholds are parameters of the functions or constants beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions.urls import domain_of, domain_suffixes, url_key

#: Patterns counted by the fidelity assessment.
MANGLED_MATH = r"[A-Za-z0-9)\]]\s?\?\s?[a-z0-9(]"
CID = r"\(cid:\d+\)"


def fidelity(df: DataFrame, text: str) -> DataFrame:
    """Adds ``n_words, mangled_math, replacements, cids, letter_part, gibberish, degraded``; null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda p: F.regexp_count(t, F.lit(p))
    df = df.withColumn("n_words", F.greatest(count(r"\S+"), F.lit(1))).withColumn("mangled_math", count(MANGLED_MATH))
    df = df.withColumn("replacements", F.length(t) - F.length(F.replace(t, F.lit("�"), F.lit("")))).withColumn("cids", count(CID))
    solid = F.greatest(count(r"\S"), F.lit(1))
    df = df.withColumn("letter_part", count("[A-Za-z]") / solid).withColumn("gibberish", (solid >= 200) & (F.col("letter_part") < 0.2))
    bad = (F.col("mangled_math") >= 8) & (F.col("mangled_math") / F.col("n_words") > 0.005)
    return df.withColumn("degraded", bad | (F.col("cids") > 5) | (F.col("replacements") / F.col("n_words") > 0.015) | F.col("gibberish"))


def fidelity_label(degraded: Column, floor: Column | None = None) -> Column:
    """What is written down: degraded by assessment, else a floor of the way of extraction, else high."""
    return F.when(degraded, "degraded").otherwise(F.coalesce(floor, F.lit("high")) if floor is not None else F.lit("high"))


def problem_rate(df: DataFrame) -> Column:
    return (F.col("mangled_math") + F.col("replacements") + F.col("cids")) / F.col("n_words")


def better_extraction(df: DataFrame, key: str, least_words: int = 100) -> DataFrame:
    """Of several assessed extractions per key the best: usable before thin, clean before degraded, lower rate of problems,
    then the first by ``method``."""
    order = [(F.col("n_words") < least_words).asc(), F.col("degraded").asc(), problem_rate(df).asc(), F.col("method").asc()]
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")


def running_lines(df: DataFrame, key: str, text: str, least_pages: int = 4) -> DataFrame:
    """``key, line, pages``: first and last lines of form-feed separated pages, numbers masked, that recur on at least three
    pages and half of them, for texts of at least ``least_pages`` pages."""
    page = df.select(key, F.posexplode(F.split(text, "\f")).alias("page", "t"), F.size(F.split(text, "\f")).alias("n")).filter(F.col("n") >= least_pages)
    lines = F.filter(F.transform(F.split("t", "\n"), T.stripped), lambda x: x != "")
    edge = page.withColumn("l", lines).filter(F.size("l") > 0).select(key, "page", "n", F.explode(F.array_distinct(F.array(F.get("l", F.lit(0)), F.get("l", F.size("l") - 1)))).alias("line"))
    masked = edge.withColumn("line", F.regexp_replace("line", r"\d+", "#")).distinct()
    return masked.groupBy(key, "line").agg(F.count("*").alias("pages"), F.first("n").alias("n")).filter(F.col("pages") >= F.greatest(F.lit(3), F.floor(F.col("n") / 2))).drop("n")


def tabularity(df: DataFrame, key: str, reading: str, aligned: str, most_chars: int = 28, most_words: int = 4, least_keys: int = 8, cut: float = 0.35) -> DataFrame:
    """``key, n_keys, promoted, promoted_part, tabular``: short lines of the text in reading order that begin a longer line of
    the aligned text. Everything happens within a row's arrays, so the comparison never leaves the record."""
    lines = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "\n"), T.stripped), lambda x: x != "")
    short = F.array_distinct(F.filter(lines(reading), lambda x: (F.length(x) <= most_chars) & (F.size(F.split(x, r"\s+")) <= most_words)))
    rows = df.select(key, short.alias("k"), lines(aligned).alias("a"))
    promoted = F.filter("k", lambda k: F.exists("a", lambda a: F.startswith(a, k) & (F.length(a) > F.length(k) + 3)))
    rows = rows.select(key, F.size("k").alias("n_keys"), F.size(promoted).alias("p"))
    enough = F.col("n_keys") >= least_keys
    part = F.when(enough, F.round(F.col("p") / F.col("n_keys"), 3)).otherwise(F.lit(0.0))
    return rows.select(key, "n_keys", F.when(enough, F.col("p")).otherwise(0).alias("promoted"), part.alias("promoted_part"), (enough & (F.col("p") / F.greatest("n_keys", F.lit(1)) >= cut)).alias("tabular"))


def extraction_choice(tabular: Column, can_table: Column, override: Column) -> Column:
    """The way of extraction that is recorded; null for plain reading order."""
    forced = F.when(override == "reading-order", F.when(tabular, "reading-order-forced")).when(override == "table", F.when(can_table, "table-aware").otherwise("error"))
    return F.when(override.isin("reading-order", "table"), forced).when(tabular, F.when(can_table, "table-aware").otherwise("table-flattened"))


def short_extraction(body: Column, description: Column, html: Column, least_words: int = 50, distinctive: int = 8, overlap: float = 0.2) -> Column:
    """Why an extraction is short: ``real``, ``wrong_node`` (its words aren't those of the description) or ``empty_shell``."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 5))
    told = words(description)
    shared = F.size(F.array_intersect(told, words(body)))
    real = html.rlike("(?i)<(article|main)[ >]") & (T.word_count(body) >= least_words)
    return F.when(real, "real").when((F.size(told) >= distinctive) & (shared / F.greatest(F.size(told), F.lit(1)) < overlap), "wrong_node").otherwise("empty_shell")


def blocked(df: DataFrame, url: str, blocklist: DataFrame) -> DataFrame:
    """``df`` and ``is_blocked``: whether the URL's domain or a parent of at least two labels is in ``blocklist (domain)``."""
    listed = blocklist.select(F.lower(F.trim("domain")).alias("suffix")).filter("suffix <> '' and not startswith(suffix, '#')").distinct().withColumn("listed", F.lit(True))
    hosts = df.select(domain_of(F.col(url)).alias("host")).filter("host is not null").distinct()
    hit = hosts.select("host", F.explode(domain_suffixes(F.col("host"))).alias("suffix")).join(listed, "suffix").groupBy("host").agg(F.lit(True).alias("is_blocked"))
    return df.withColumn("host", domain_of(F.col(url))).join(hit, "host", "left").withColumn("is_blocked", F.coalesce("is_blocked", F.lit(False))).drop("host")


def duplicate_urls(clips: DataFrame) -> DataFrame:
    """``url_key, n, first_path``: URLs captured more than once."""
    return clips.filter("source is not null").groupBy(url_key(F.col("source")).alias("url_key")).agg(F.count("*").alias("n"), F.min("path").alias("first_path")).filter("n > 1")


def duplicate_plan(clips: DataFrame, cited: DataFrame) -> DataFrame:
    """What to do with clips of equal content hash: ``path, source_hash, action``. If some of a group are cited, the others go;
    if all or none are, the group is refused. Clips without a hash are equal to nothing. cited: ``path``."""
    rows = clips.filter("source_hash is not null").select("path", F.lower("source_hash").alias("source_hash"))
    rows = rows.join(cited.select("path", F.lit(True).alias("c")).distinct(), "path", "left").withColumn("c", F.coalesce("c", F.lit(False)))
    groups = rows.groupBy("source_hash").agg(F.count("*").alias("n"), F.count_if("c").alias("n_cited")).filter("n > 1")
    action = F.when(F.col("n_cited") == F.col("n"), "refuse_all_cited").when(F.col("n_cited") == 0, "refuse_none_cited").when(F.col("c"), "keep").otherwise("remove")
    return rows.join(groups, "source_hash").select("path", "source_hash", action.alias("action"))


def capture_status(df: DataFrame, blocklist: DataFrame, declined: DataFrame, words: Column, least_words: int = 100) -> DataFrame:
    """``df`` (with ``clip_id, source, source_hash, captured_at``) and ``outcome``, the first that holds: blocked, declined,
    duplicate_url (an earlier capture has the URL), thin, duplicate_hash, clipped. declined: ``url_key``."""
    rows = blocked(df, "source", blocklist).withColumn("url_key", url_key(F.col("source"))).withColumn("hash_key", F.nullif(F.lower(F.trim("source_hash")), F.lit("")))
    rows = rows.join(declined.select("url_key", F.lit(True).alias("is_declined")).distinct(), "url_key", "left")
    # the first capture of a URL or hash by aggregation, as a window would bring all rows of a hot key to one task
    first = lambda k: df_first(rows, k)
    rows = rows.join(first("url_key"), "url_key", "left").join(first("hash_key"), "hash_key", "left")
    outcome = (
        F.when(F.col("is_blocked"), "blocked").when(F.col("is_declined"), "declined").when(F.col("clip_id") != F.col("url_key_first"), "duplicate_url")
        .when(words < least_words, "thin").when(F.col("clip_id") != F.col("hash_key_first"), "duplicate_hash").otherwise("clipped")
    )
    return rows.withColumn("outcome", outcome).drop("is_blocked", "is_declined", "url_key", "hash_key", "url_key_first", "hash_key_first")


def df_first(rows: DataFrame, key: str) -> DataFrame:
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("captured_at", "clip_id")).alias("f")).select(key, F.col("f.clip_id").alias(f"{key}_first"))
