"""Link graph: resolution of link targets, degrees, orphans, evidence, broken links, score.

Pages are ``path, name, ...`` (name in lower case), links ``source, pos, channel, target``, and resolved links have ``resolved``
as well. Where several pages share a name the first in order of path counts. Joins are left to the optimiser: the name index
is as large as the pages, so no hint forces it onto all executors; adaptive execution broadcasts it where it is small and
splits hot targets where it isn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators.repair import resolve_dewrap
from gleanery.operators.vault import is_content, is_evidence, is_root, is_stub

#: Score: weight and cap per finding.
SCORE = {"defects": (3, 30), "stale": (2, 15), "orphans": (2, 25), "dead_ends": (2, 20), "provenance_gaps": (4, 20), "unreachable": (3, 20)}


def name_index(pages: DataFrame) -> DataFrame:
    """``key, path, nav_path``: keys are bare names and full paths (lower case, no ``.md``); a name comes before a path that
    spells the same. nav_path is where a reader would land: content before other pages."""
    both = pages.select(F.col("name").alias("key"), "path", F.lit(0).alias("kind")).unionByName(
        pages.select(F.lower(F.regexp_replace("path", r"(?i)\.md$", "")).alias("key"), "path", F.lit(1).alias("kind"))
    )
    first = F.min(F.struct("kind", "path"))
    nav = F.min(F.when(F.col("kind") == 0, F.struct((~is_content(F.col("path"))).alias("other"), F.col("path").alias("path"))))
    return both.groupBy("key").agg(first.alias("f"), nav.alias("n")).select("key", F.col("f.path").alias("path"), F.coalesce("n.path", "f.path").alias("nav_path"))


def resolve(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links with ``resolved`` (provenance reading) and ``landed`` (the reading of the link's channel); null where broken.

    Keys tried in order: the target as written, without ``.md``, and its last part; the first that is present counts."""
    index = name_index(pages)
    low = F.lower("target")
    full = F.regexp_replace(low, r"\.md$", "")
    last = F.regexp_extract(full, r"([^/]*)$", 1)
    keyed = links.withColumn("__k", F.array(low, full, F.when(last == "", full).otherwise(last)))
    # one shuffle for all three keys: distinct targets only, exploded
    targets = keyed.select("target", "__k").distinct().select("target", F.posexplode("__k").alias("nth", "key"))
    hit = targets.join(index, "key").groupBy("target").agg(F.min(F.struct("nth", "path", "nav_path")).alias("h"))
    hit = hit.select("target", F.col("h.path").alias("resolved"), F.col("h.nav_path").alias("__nav"))
    out = keyed.drop("__k").join(hit, "target", "left")
    return out.withColumn("landed", F.when(F.col("channel") == "nav", F.col("__nav")).otherwise(F.col("resolved"))).drop("__nav")


def inbound(resolved: DataFrame) -> DataFrame:
    """``path, inbound``: every link of a content page counts, repeats and links to itself too."""
    return resolved.filter(is_content(F.col("source")) & F.col("landed").isNotNull()).groupBy(F.col("landed").alias("path")).agg(F.count("*").alias("inbound"))


def referrers(resolved: DataFrame) -> DataFrame:
    """``path, referrer``: distinct pages that link to another one, from all pages."""
    return resolved.filter("landed is not null and landed <> source").select(F.col("landed").alias("path"), F.col("source").alias("referrer")).distinct()


def orphans(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    return pages.filter(is_content(F.col("path")) & ~is_root(F.col("path"))).join(inbound(resolved), "path", "left_anti").select("path")


def dead_ends(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """Content pages whose text has no link that leads anywhere; citations don't count."""
    alive = resolved.filter("channel = 'nav' and landed is not null").select(F.col("source").alias("path"))
    return pages.filter(is_content(F.col("path"))).join(alive, "path", "left_anti").select("path")


def broken(resolved: DataFrame) -> DataFrame:
    """``source, target``: links that lead nowhere, once each."""
    return resolved.filter(is_content(F.col("source")) & F.col("landed").isNull()).select("source", "target").distinct()


def hub_stubs(pages: DataFrame, resolved: DataFrame, least: int = 5) -> DataFrame:
    return pages.filter(is_content(F.col("path")) & is_stub(F.col("status"), F.col("words"))).join(inbound(resolved).filter(F.col("inbound") >= least), "path").select("path", "inbound")


def unparsed(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    return pages.filter(F.col("path").startswith("raw/")).join(inbound(resolved), "path", "left_anti").select("path")


def _raw_citing(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("resolved").startswith("raw/")).select(F.col("source").alias("path"))


def backlog(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """Clips no source page accounts for: neither is their hash recorded, nor does a source page without hashes cite them."""
    sources = pages.filter(F.col("path").startswith("wiki/sources/"))
    recorded = sources.select(F.explode("source_hashes").alias("source_hash")).filter("source_hash is not null and source_hash <> ''").distinct()
    without = sources.filter(F.coalesce(F.size("source_hashes"), F.lit(0)) < 1).select(F.col("path").alias("source"))
    legacy = resolved.join(without, "source", "left_semi").filter("resolved is not null").select(F.col("resolved").alias("path"))
    clips = pages.filter(F.col("path").startswith("raw/") & F.col("path").endswith(".md"))
    return clips.join(recorded, "source_hash", "left_anti").join(legacy, "path", "left_anti").select("path")


def missing_hash(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("path").startswith("raw/") & F.col("path").endswith(".md") & F.col("source_hash").isNull()).select("path")


def backfill_pending(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """Source pages that cite raw files but record no hashes."""
    without = pages.filter(F.col("path").startswith("wiki/sources/") & (F.coalesce(F.size("source_hashes"), F.lit(0)) < 1))
    return without.join(_raw_citing(resolved), "path", "left_semi").select("path")


def _declares(pages: DataFrame) -> Column:
    """Whether a page declares that it has no sources; pages without such a column say nothing."""
    return F.coalesce(F.col("declares_no_sources"), F.lit(False)) if "declares_no_sources" in pages.columns else F.lit(False)


def provenance_gaps(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """Source pages that cite no raw file and don't declare that they have none."""
    return pages.filter(F.col("path").startswith("wiki/sources/") & ~_declares(pages)).join(_raw_citing(resolved), "path", "left_anti").select("path")


def declared_gaps(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """Content pages that declare no sources and have none: source pages that cite no raw file, others that reach none."""
    said = pages.filter(_declares(pages) & is_content(F.col("path"))).select("path")
    own = F.col("path").startswith("wiki/sources/")
    without = said.filter(own).join(_raw_citing(resolved), "path", "left_anti")
    reached = evidence_walk(resolved.select("source", F.col("resolved").alias("target")), said.filter(~own), is_evidence)
    return without.unionByName(said.filter(~own).join(reached.filter(F.col("evidence").startswith("raw/")), "path", "left_anti"))


def declared_stubs(pages: DataFrame) -> DataFrame:
    return pages.filter(is_content(F.col("path")) & (F.col("status") == "stub")).select("path")


def monoliths(pages: DataFrame, words: int = 3000, callouts: int = 3) -> DataFrame:
    """Authored pages of more than ``words`` words with at least ``callouts`` dated updates. pages: ``path, words, callouts``."""
    return pages.filter(is_content(F.col("path")) & F.col("path").startswith("wiki/authored/") & (F.col("words") > words) & (F.col("callouts") >= callouts)).select("path")


def evidence_walk(edges: DataFrame, starts: DataFrame, evidence, depth: int = 3, edges_distinct: bool = False) -> DataFrame:
    """``path, evidence``: evidence reached within ``depth`` hops of ``starts (path)``; the first hop must be evidence.

    edges: ``source, target``. evidence: a function from the column of a path to whether it is evidence. Unrolled into ``depth``
    joins; the frontier is reduced to distinct pairs that go on before a hop, so it never holds more than one row per pair.
    edges_distinct: whether the caller has made them so."""
    e = edges.filter("source is not null and target is not null").select("source", "target")
    e = e if edges_distinct else e.distinct()
    sources = e.select(F.col("source").alias("at")).distinct()
    step = starts.join(e, F.col("path") == F.col("source")).select("path", F.col("target").alias("at")).filter(evidence(F.col("at")))
    seen = step
    for hop in range(2, depth + 1):
        if hop > 2:  # on from what has edges only; all that was seen is reduced once, at the end
            step = step.join(sources, "at", "left_semi").select("path", "at").distinct()
        step = step.join(e, F.col("at") == F.col("source")).select("path", F.col("target").alias("at"))
        seen = seen.unionByName(step)
    return seen.filter(evidence(F.col("at")) & (F.col("at") != F.col("path"))).distinct().select("path", F.col("at").alias("evidence"))


def unreachable(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """Wiki pages other than source pages from which no raw file is reached and that don't declare that they have none."""
    need = pages.filter(F.col("path").startswith("wiki/") & ~F.col("path").startswith("wiki/sources/") & ~_declares(pages)).select("path")
    reached = evidence_walk(resolved.select("source", F.col("resolved").alias("target")), need, is_evidence)
    return need.join(reached.filter(F.col("evidence").startswith("raw/")), "path", "left_anti")


def suggestions(targets: DataFrame, pages: DataFrame, most: int = 2) -> DataFrame:
    """``target, suggest``: content page whose name is the target's in other spelling, or else is within ``most`` edits.

    A known name is cut into ``most + 1`` parts; ``most`` edits leave one part as it is, moved by at most ``most`` places. So
    names are joined on length, part and its text, and only what collides is compared, never all with all."""
    known = pages.filter(is_content(F.col("path"))).select(T.normal_name(F.col("name")).alias("nn"), F.coalesce("title", "name").alias("real"), "path")
    known = known.groupBy("nn").agg(F.min(F.struct("path", "real")).alias("p")).select("nn", F.col("p.real").alias("real"), F.col("p.path").alias("path"))
    wanted = targets.select("target", T.normal_name(F.col("target")).alias("nt")).distinct()
    exact = wanted.join(known.filter("nn <> ''"), F.col("nt") == F.col("nn")).filter("real <> target").select("target", "real", F.lit(0).alias("rank"), "path")

    def cuts(c: Column) -> Column:
        n = F.length(c)
        third = F.greatest(F.floor(n / (most + 1)), F.lit(1)).cast("int")
        parts = [F.substring(c, F.lit(i) * third + 1, third if i < most else n) for i in range(most + 1)]
        return F.array(*parts), third, n

    parts, third, length = cuts(F.col("nn"))
    keyed = known.select("nn", "real", "path", length.alias("n"), F.posexplode(parts).alias("i", "part"), third.alias("w")).filter("part <> ''")
    spots = wanted.filter("length(nt) > 0").withColumn("m", F.length("nt"))
    # every length a near name may have, every part of it, every shift
    spots = spots.withColumn("n", F.explode(F.sequence(F.greatest(F.col("m") - most, F.lit(1)), F.col("m") + most)))
    spots = spots.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("shift", F.explode(F.sequence(F.lit(-most), F.lit(most))))
    w = F.greatest(F.floor(F.col("n") / (most + 1)), F.lit(1)).cast("int")
    begin = F.col("i") * w + 1 + F.col("shift")
    size = F.when(F.col("i") < most, w).otherwise(F.col("n") - most * w)
    spots = spots.filter((begin >= 1) & (size >= 1)).withColumn("part", F.substring("nt", begin, size)).filter(F.length("part") == size)
    near = spots.select("target", "nt", "n", "i", "part").distinct().join(keyed, ["n", "i", "part"])
    near = near.filter(F.levenshtein("nt", "nn", most) >= 0).select("target", "real", F.lit(1).alias("rank"), "path")
    # forms of at most ``most`` ASCII characters: their number is bounded, whatever the number of targets
    few = wanted.filter(F.length("nt") <= most).select("nt").distinct().join(known.filter(F.length("nn") <= most), F.levenshtein("nt", "nn", most) >= 0).select("nt", "real", "path")
    tiny = wanted.join(few, "nt").select("target", "real", F.lit(1).alias("rank"), "path")
    return exact.unionByName(near).unionByName(tiny).groupBy("target").agg(F.min(F.struct("rank", "path", "real")).alias("s")).select("target", F.col("s.real").alias("suggest"))


def classify_broken(bad: DataFrame, pages: DataFrame, today: str, stale_days: int = 90, demand: int = 3) -> DataFrame:
    """``source, target, class, suggest, refs``: defect (a near page exists, or the link runs over a line end), stale (old page,
    little asked for) or deferred. refs: broken links with this target."""
    refs = bad.groupBy("target").agg(F.count("*").alias("refs"))
    dates = pages.select(F.col("path").alias("source"), F.coalesce("updated", "created").alias("day"))
    targets = refs.select("target")
    wrapped = F.col("target").contains("\n")
    # a target over several lines can only mean what its joined forms name; others are held against near names
    names = pages.filter(is_content(F.col("path"))).select("name")
    near = suggestions(targets.filter(~wrapped), pages).unionByName(resolve_dewrap(targets.filter(wrapped), names).select("target", F.col("chosen").alias("suggest")))
    rows = bad.join(refs.join(near, "target", "left"), "target").join(dates, "source", "left")
    age = F.datediff(F.lit(today).cast("date"), F.col("day"))
    kind = F.when(F.col("target").contains("\n") | F.col("suggest").isNotNull(), "defect").when((age > stale_days) & (F.col("refs") < demand), "stale").otherwise("deferred")
    return rows.select("source", "target", kind.alias("class"), "suggest", "refs")


def health(counts: DataFrame) -> DataFrame:
    """One row: the counts of ``finding, n`` as columns and the score from 0 to 100."""
    n = {f: F.coalesce(F.max(F.when(F.col("finding") == f, F.col("n"))), F.lit(0)) for f in SCORE}
    loss = sum((F.least(F.lit(cap), F.lit(weight) * n[f]) for f, (weight, cap) in SCORE.items()), F.lit(0))
    return counts.agg(*[n[f].cast("bigint").alias(f) for f in SCORE], F.greatest(F.lit(0), F.lit(100) - loss).cast("bigint").alias("score"))
