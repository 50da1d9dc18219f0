"""Upkeep of a vault: grades of sources and readings, purges and declines, backlogs, running lines, the desk's bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators.catalog import BACKLOG, ordinal

#: Grades of a reading that ask for nothing.
HEALTHY = ["high", "ok", "clean"]
#: Points of a source and the least points of its grades.
POINTS = {"primary": 2, "recent": 1, "known_author": 1, "corroborated": 1, "promotional": -1}
GRADES = [(4, "high"), (2, "medium"), (0, "low")]


def credibility(flags: dict[str, Column]) -> Column:
    """The grade of a source from its flags (null counts as no): ``high``, ``medium``, ``low`` or ``reject``."""
    points = sum((F.when(flags[name], weight).otherwise(0) for name, weight in POINTS.items() if name in flags), F.lit(0))
    grade = F.lit("reject")
    for least, name in reversed(GRADES):
        grade = F.when(points >= least, name).otherwise(grade)
    return grade


def is_flagged(fidelity: Column) -> Column:
    """Whether a reading says something of its quality that asks for a look."""
    return F.coalesce((fidelity != "") & ~fidelity.isin(HEALTHY), F.lit(False))


def tries_recognition(words: Column, degraded: Column, least: int = 100) -> Column:
    """Whether a text is so thin or damaged that its pages should be recognised as images."""
    return (words < least) | degraded


def thin_outcome(available: Column) -> Column:
    """What a text too thin is put down as: declined only where recognition was there to try, else nothing was learned."""
    return F.when(F.coalesce(available, F.lit(False)), "thin").otherwise("ocr-unavailable")


def is_drift_scope(path: Column) -> Column:
    return path.rlike("^wiki/(concepts|syntheses)/")


def project_slug(project: Column) -> Column:
    return F.replace(project, F.lit("/"), F.lit("-"))


def seeds(pages: DataFrame, limit: int = 25) -> DataFrame:
    """The first wiki pages by path that a purge is offered to begin with."""
    return pages.filter(F.col("path").startswith("wiki/")).select("path").orderBy("path").limit(limit)


def log_view(df: DataFrame, *columns: str, date: str) -> DataFrame:
    """The saved view of a log: its columns, newest first."""
    return df.select(*columns).orderBy(F.col(date).desc_nulls_last(), *columns)


def replayed_declines(manifests: DataFrame, declined: DataFrame) -> DataFrame:
    """``url``: addresses that manifests declined and that are not declined now, whatever their case, in the spelling of the
    first manifest. manifests: ``at, url``; declined: ``url``."""
    low = F.lower("url").alias("k")
    first = manifests.filter("url is not null").groupBy(low).agg(F.min(F.struct("at", "url")).alias("u")).select("k", F.col("u.url").alias("url"))
    return first.join(declined.filter("url is not null").select(low).distinct(), "k", "left_anti").select("url")


def free_ids(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """``id, free``: the first of ``id``, ``id-2``, ``id-3``, ... that is not taken. wanted and taken: ``id``."""
    ids = wanted.select("id").distinct()
    parts = taken.select(F.col("id").alias("t")).distinct()
    numbered = parts.select(F.regexp_extract("t", r"^(.*)-(\d+)$", 1).alias("id"), F.expr(r"try_cast(regexp_extract(t, '-([2-9]|[1-9][0-9]+)$', 1) as bigint)").alias("n")).filter("n is not null")
    own = ids.join(parts.select(F.col("t").alias("id"), F.lit(1).cast("bigint").alias("n")), "id").select("id", "n")
    used = own.unionByName(ids.join(numbered, "id").select("id", "n"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("n"))
    # numbers taken without a gap from 1 on stand at their own place
    run = used.withColumn("place", place).filter("n = place").groupBy("id").agg(F.max("n").alias("last"))
    free = ids.join(run, "id", "left").withColumn("next", F.coalesce("last", F.lit(0)) + 1)
    return free.select("id", F.when(F.col("next") == 1, F.col("id")).otherwise(F.concat("id", F.lit("-"), "next")).alias("free"))


def manifests(entries: DataFrame, key: str, *columns: str) -> DataFrame:
    """``key, n, first_entry``: size of each manifest and its first entry in order of the columns, as JSON: what a reader of
    the folder sees at a glance; the entries themselves stay rows and are written by ``key``."""
    body = F.struct(*columns)
    return entries.groupBy(key).agg(F.count("*").alias("n"), F.min(body).alias("b")).select(key, "n", F.to_json("b", {"ignoreNullFields": "false"}).alias("first_entry"))


def roadmap(pages: DataFrame, project: str, status: str, order: list[str] | None = None) -> DataFrame:
    """``project, place, status, path``: items of a backlog per project, grouped by status in the order shown; others last."""
    known = order or BACKLOG
    value = F.when(F.col(status).isin(known), F.col(status)).otherwise("other")
    return pages.filter(F.col(project).isNotNull()).select(F.col(project).alias("project"), ordinal(value, known).cast("int").alias("place"), value.alias("status"), "path")


def tally(findings: DataFrame, category: str, item: str, shown: int = 5) -> DataFrame:
    """``category, n, first``: findings per category and the first few of them in order."""
    place = F.row_number().over(Window.partitionBy(category).orderBy(item))
    top = findings.withColumn("__n", place).filter(F.col("__n") <= shown).groupBy(category).agg(F.array_join(F.array_sort(F.collect_list(item)), "\n").alias("first"))
    return findings.groupBy(category).agg(F.count("*").alias("n")).join(top, category).select(category, "n", "first")


def bundle(lists: dict[str, DataFrame], limits: dict[str, int] | None = None) -> DataFrame:
    """``list, url, total``: the lists of the desk in one frame, those with a limit cut to their first rows by url, each with its
    whole size."""
    out = None
    for name, df in lists.items():
        rows = df.select(F.lit(name).alias("list"), "url")
        total = F.broadcast(rows.agg(F.count("*").alias("total")))  # one row
        rows = rows.orderBy("url").limit(limits[name]) if limits and name in limits else rows
        rows = rows.join(total)
        out = rows if out is None else out.unionByName(rows)
    return out


def without_running_lines(text: Column, least_pages: int = 4) -> Column:
    """A text without its running headers and footers: of form-feed separated pages (at least ``least_pages``), the first and
    last lines are emptied where they, numbers masked, come on half the pages and three at least. Pages are joined by LF.
    Everything stays within the row."""
    pages = F.split(text, "\f", -1)
    mask = lambda line: F.regexp_replace(T.stripped(line), r"\d+", "#")

    def filled(page: Column) -> Column:
        lines = F.split(page, "\n", -1)
        return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: T.stripped(F.get(lines, i)) != "")

    def edges(page: Column) -> Column:
        lines, at = F.split(page, "\n", -1), filled(page)
        return F.when(F.size(at) > 0, F.array(mask(F.get(lines, F.get(at, F.lit(0)))), mask(F.get(lines, F.get(at, F.size(at) - 1))))).otherwise(F.array().cast("array<string>"))

    often = F.flatten(F.transform(pages, edges))
    least = F.greatest(F.lit(3), F.floor(F.size(pages) * 0.5))
    running = F.filter(F.array_distinct(often), lambda x: F.size(F.filter(often, lambda y: y == x)) >= least)

    def cleaned(page: Column) -> Column:
        lines, at = F.split(page, "\n", -1), filled(page)
        ends = F.array(F.get(at, F.lit(0)), F.get(at, F.size(at) - 1))
        return F.array_join(F.transform(lines, lambda line, i: F.when(F.array_contains(ends, i) & F.array_contains(running, mask(line)), "").otherwise(line)), "\n")

    return F.when(F.size(pages) < least_pages, F.array_join(pages, "\n")).otherwise(F.array_join(F.transform(pages, cleaned), "\n"))


def sources_in_order(text: Column) -> Column:
    """Frontmatter in which a list of hashes stands between ``sources:`` and its items, with the items moved up."""
    return F.regexp_replace(text, r"(?m)\A(---\r?\n(?:(?!---).*\r?\n)*?)sources:[ \t]*\r?\n(source-hashes:.*)\r?\n((?:[ \t]*-(?!--).*\r?\n)+)", "$1sources:\n$3$2\n")


def without_field(text: Column, name: str) -> Column:
    """A text without the lines of one scalar field in its frontmatter."""
    head = F.regexp_extract(text, T.FRONTMATTER, 0)
    return F.concat(F.regexp_replace(head, rf"(?m)^{name}:.*\r?\n", ""), F.substring(text, F.length(head) + 1, F.length(text)))


def with_fields(text: Column, fields: dict[str, Column]) -> Column:
    """A text whose frontmatter has the fields, those it lacks added at its end; unchanged without frontmatter."""
    head, fm = F.regexp_extract(text, T.FRONTMATTER, 0), T.frontmatter(text)
    added = F.concat(*[F.when(fm.rlike(rf"(?m)^{k}:") | v.isNull(), "").otherwise(F.concat(F.lit(f"\n{k}: "), v)) for k, v in fields.items()])
    return F.when(fm == "", text).otherwise(F.concat(F.lit("---\n"), fm, added, F.lit("\n---"), F.substring(text, F.length(head) + 1, F.length(text))))
