"""Problem 9: long exact spans shared between records.

Tokens are characters. Rabin-Karp hashes of every window of ``GRAM`` characters are made by prefix sums, and of any
``LENGTH - GRAM + 1`` consecutive windows the least hash is an anchor (winnowing), so every span of at least ``LENGTH``
characters that two records share has an anchor in common, at the same place within the span. Anchors are counted in Spark;
those of more than one record are looked at again, now with the characters around them, which are enough to tell exactly
whether a window of ``LENGTH`` characters around the anchor is equal. Overlapping windows merge into maximal intervals.

With ``gram`` equal to ``length`` every window is an anchor, which is the plain method: all windows are counted and repeated
ones merged. The results are the same; the shuffle is some sixty times as large.

Scale. Counting shuffles one row of two numbers per some sixty characters, pre-combined; the text itself is never shuffled.
Which anchors repeat is told to the second reading by Bloom filters of two probes and at most ``BLOOM_BITS`` bits (32 MB),
each for ``FILTERED`` anchors at most; if more repeat, the texts are read once per range of hashes. False positives (a
twentieth at most) cost bytes, not results. Anchors with more than ``HOT`` occurrences are told by a broadcast of their
hashes up to ``FEW`` of them and by a salted join beyond that, so that none gathers in one task; for the pair result they are
paired in blocks of records over many tasks, for the interval result not at all, but all their windows of ``length``
characters are hashed and counted.

Null, empty and short texts share nothing. Copies of a row, and rows of one id, do not share with each other. Overlaps of a
text with itself do not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.session import stored

LENGTH = 200
GRAM = 80
#: Most bits of the filter of repeated anchors: 2**28 bits are 32 MB.
BLOOM_BITS = 28
#: Anchors in one filter at most: eight bits each.
FILTERED = 1 << 25
#: Occurrences of one anchor that are paired within one task.
HOT = 256
#: Hot anchors that are broadcast at most, and parts that others are salted into.
FEW, SALTS = 200_000, 32
#: Characters hashed at a time; positions within must fit 20 bits.
_BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK64 = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_UP = _powers(_BASE, _BLOCK + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), _BLOCK + 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """Rabin-Karp hash of every window of ``gram`` code points, from prefix sums modulo 2**64 over mixed characters."""
    if len(codes) < gram:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        terms = _mix(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * _UP[: len(codes)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        return _mix((sums[gram:] - sums[:-gram]) * _DOWN[: len(codes) - gram + 1])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(codes: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of joined texts, ``starts`` being where each begins (and the end of all)."""
    width = length - gram + 1
    places, hashes = [], []
    ends = np.asarray(starts[1:])
    step = _BLOCK - length + 1
    for a in range(0, max(1, len(codes) - length + 1), step):
        part = codes[a : a + _BLOCK]
        if len(part) < length:
            break
        h = window_hashes(part, gram)
        # ties go to the last: places count down from the end
        keyed = (h & np.uint64(_MASK64 ^ 0xFFFFF)) | (np.uint64(0xFFFFF) - np.arange(len(h), dtype=np.uint64))
        least = _sliding_min(keyed, width)
        at = np.arange(a, a + len(least))
        inside = at + length <= ends[np.searchsorted(ends, at, side="right")]
        kept = np.unique(least[inside])
        place = (np.uint64(0xFFFFF) - (kept & np.uint64(0xFFFFF))).astype(np.int64)
        places.append(a + place)
        hashes.append(h[place].view(np.int64))
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _texts(df: DataFrame, key: str, text: str, length: int) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("d"), F.col(text).alias("t")).filter(F.col("d").isNotNull() & (F.length("t") >= length))


def repeated_anchors(docs: DataFrame, key: str, text: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(h)``: hashes of the anchors that stand in more than one record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, starts = _joined(batch.column(1).to_pylist())
            place, h = anchors(codes, starts, length, gram)
            owner = np.searchsorted(starts, place, side="right") - 1
            first = np.unique(np.stack([owner, h]), axis=1)  # once per record: texts that repeat themselves have many
            d = batch.column(0).to_numpy()[first[0]]
            yield pa.RecordBatch.from_arrays([pa.array(first[1]), pa.array(d)], names=["h", "d"])

    found = _texts(docs, key, text, length).mapInArrow(run, "h bigint, d bigint")
    return found.groupBy("h").agg(F.min("d").alias("a"), F.max("d").alias("b")).filter("a <> b").select("h")


def _cells(h, bits: int) -> tuple:
    """Two cells of the filter for a hash, of a column or an array."""
    mask = (1 << bits) - 1
    return (h.bitwiseAND(mask), F.shiftright(h, 32).bitwiseAND(mask)) if not isinstance(h, np.ndarray) else (h & mask, h >> 32 & mask)


def _bloom(repeated: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """The filter of ``n`` anchors as bits: slices of 8192 bits are packed on the executors, at most 32 MB in all."""
    bits = min(BLOOM_BITS, max(16, (8 * max(1, n)).bit_length()))
    low = min(13, bits)

    def pack(batch: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << low, bool)
        flags[batch["low"].to_numpy()] = True
        return pd.DataFrame({"part": [int(batch["part"].iloc[0])], "bits": [np.packbits(flags).tobytes()]})

    cell = F.explode(F.array(*_cells(F.col("h"), bits)))
    parts = repeated.select(cell.alias("cell")).select(F.shiftright("cell", low).alias("part"), F.col("cell").bitwiseAND((1 << low) - 1).alias("low")).distinct()
    filled = parts.groupBy("part").applyInPandas(pack, "part bigint, bits binary")
    out = np.zeros((1 << (bits - low), 1 << (low - 3)), np.uint8)
    for row in filled.toLocalIterator():
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel(), bits


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(h, d, at, left, right, more)``: the occurrences of repeated anchors with up to ``length - gram`` characters on each
    side, kept in the shared folder, as the results read them more than once. Occurrences of a record that look the same are
    one row; ``more`` has the places of the others."""
    repeated = stored(repeated_anchors(docs, key, text, length, gram), "anchors")
    n = repeated.count()
    ranges = max(1, -(-n // FILTERED))
    found = None
    for r in range(ranges):
        flags, bits = _bloom(repeated.filter(F.pmod(F.shiftright("h", 3), F.lit(ranges)) == r), n // ranges + 1)
        part = _texts(docs, key, text, length).mapInArrow(_reading(docs.sparkSession.sparkContext.broadcast(flags), bits, r, ranges, length, gram), _OCCURRENCE)
        found = part if found is None else found.unionByName(part)
    return stored(found, "occurrences")


_OCCURRENCE = "h bigint, d bigint, at bigint, left string, right string, more array<bigint>"


def _reading(shared, bits: int, nth: int, ranges: int, length: int, gram: int):
    """Reads texts again for the anchors of one range of hashes that the filter holds."""
    side = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(1).to_pylist()
            codes, starts = _joined(texts)
            place, h = anchors(codes, starts, length, gram)
            hit = (h >> 3) % ranges == nth
            for cell in _cells(h, bits):
                hit &= (table[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0
            place, h = place[hit], h[hit]
            owner = np.searchsorted(starts, place, side="right") - 1
            at = place - starts[owner]
            seen: dict[tuple, int] = {}
            rows: list[tuple] = []
            more: list[list[int]] = []
            for o, p, x in zip(owner.tolist(), at.tolist(), h.tolist()):
                t = texts[o]
                k = (o, x, t[max(0, p - side) : p], t[p + gram : p + gram + side])
                if (n := seen.setdefault(k, len(rows))) == len(rows):
                    rows.append((o, x, p, k[2], k[3]))
                    more.append([])
                else:
                    more[n].append(p)
            o, x, p, left, right = zip(*rows) if rows else ((),) * 5
            d = batch.column(0).to_numpy()[np.array(o, np.int64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()), pa.array(d, pa.int64()), pa.array(p, pa.int64()), pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(more, pa.list_(pa.int64()))],
                names=["h", "d", "at", "left", "right", "more"],
            )

    return run


def _matrix(texts: list[str], side: int, left: bool, salt: int) -> np.ndarray:
    """Code points going away from the anchor; beyond the end of the text stands what equals nothing else."""
    joined = "".join(t[::-1] if left else t for t in texts)
    flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts])
    out = np.repeat((np.uint32(0x200000) + np.arange(len(texts), dtype=np.uint32) * np.uint32(2) + np.uint32(salt))[:, None], side, axis=1)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(texts)), lengths), col] = flat
    return out


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if not x.shape[1]:
        return np.zeros(len(x), np.int64)
    differ = x != y
    return np.where(differ.any(1), differ.argmax(1), x.shape[1])


def _matches(length: int, gram: int, crossed: bool, once: bool):
    """Walks occurrences sorted by group, pairs each group's records and keeps pairs with ``length`` equal characters."""
    side = length - gram

    def pairs_of(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        left, right = _matrix(batch["left"].tolist(), side, True, 0), _matrix(batch["right"].tolist(), side, False, 1)
        d, at = batch["d"].to_numpy(), batch["at"].to_numpy()
        group = batch["g"].to_numpy()
        others = None if once else [np.r_[p, np.asarray(m, np.int64)] for p, m in zip(at, batch["more"])]
        begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        ends = np.r_[begins[1:], len(group)]
        i, j = [], []
        for a, b in zip(begins, ends):
            if b - a < 2:
                continue
            x, y = np.triu_indices(b - a, 1)
            i.append(a + x)
            j.append(a + y)
        if not i:
            return
        i, j = np.concatenate(i), np.concatenate(j)
        ok = d[i] != d[j]
        if crossed:
            part = batch["part"].to_numpy()
            ok &= (part[i] != part[j]) | batch["alone"].to_numpy()[i]
        i, j = i[ok], j[ok]
        for a in range(0, len(i), 50_000):
            x, y = i[a : a + 50_000], j[a : a + 50_000]
            lo, hi = _agreement(left[x], left[y]), _agreement(right[x], right[y])
            good = lo + gram + hi >= length
            x, y, lo, hi = x[good], y[good], lo[good], hi[good]
            if once:
                yield pd.DataFrame({"a": np.minimum(d[x], d[y]), "b": np.maximum(d[x], d[y])}).drop_duplicates()
            else:
                hits = pd.DataFrame({"i": np.r_[x, y], "lo": np.r_[lo, lo], "hi": np.r_[hi, hi]}).drop_duplicates()
                n = np.array([len(others[k]) for k in hits["i"]], np.int64)
                place = np.concatenate([others[k] for k in hits["i"]]) if len(hits) else np.empty(0, np.int64)
                r = np.repeat(np.arange(len(hits)), n)
                k, a_, b_ = hits["i"].to_numpy()[r], hits["lo"].to_numpy()[r], hits["hi"].to_numpy()[r]
                yield pd.DataFrame({"d": d[k], "start": place - a_, "end": place + gram + b_}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(batch):
                continue
            last = batch["g"].to_numpy() != batch["g"].iloc[-1]
            n = int(last.sum())  # sorted: the last group may go on
            rest = batch.iloc[n:].reset_index(drop=True)
            if n:
                yield from pairs_of(batch.iloc[:n].reset_index(drop=True))
        if rest is not None and len(rest):
            yield from pairs_of(rest)

    return run


def _beside(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined (left) to ``few``, of which each key is one row: by broadcast if there are at most ``FEW``, else salted, as
    a key may stand in any number of rows."""
    if few.count() <= FEW:
        return rows.join(F.broadcast(few), keys, "left")
    copies = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(SALTS)).cast("int")).join(copies, [*keys, "salt"], "left").drop("salt")


def _sized(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences of anchors that are not hot, and of those that are (with the number of their occurrences)."""
    hot = stored(found.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > HOT), "hot")
    marked = _beside(found, hot, ["h"])
    return marked.filter(F.col("n").isNull()).drop("n"), marked.filter(F.col("n").isNotNull())


def _hot_blocks(hot: DataFrame) -> DataFrame:
    """Hot anchors in blocks of about half of HOT records; each pair of blocks is one group, so no task holds all of one."""
    blocks = F.ceil(F.col("n") * 2 / HOT).cast("int")
    mine = hot.withColumn("blocks", blocks).withColumn("part", F.pmod(F.xxhash64("d"), F.col("blocks")).cast("int"))
    met = mine.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    g = F.xxhash64("h", F.least("part", "with"), F.greatest("part", "with"))
    return met.withColumn("g", g).withColumn("alone", F.col("part") == F.col("with"))


def shared_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(doc_id_a, doc_id_b)``, smaller first: records with at least ``length`` consecutive characters in common."""
    cold, hot = _sized(occurrences(docs, key, text, length, gram))
    one = cold.withColumn("g", F.col("h")).select("g", "d", "at", "left", "right").repartition("g").sortWithinPartitions("g")
    two = _hot_blocks(hot).select("g", "d", "at", "left", "right", "part", "alone").repartition("g").sortWithinPartitions("g")
    schema = "a bigint, b bigint"
    both = one.mapInPandas(_matches(length, gram, False, True), schema).unionByName(two.mapInPandas(_matches(length, gram, True, True), schema))
    return both.distinct().select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def shared_intervals(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(key, start, end)``: the maximal intervals of each record (from 0, end not included) that stand in another one too,
    each at least ``length`` long and made of windows of ``length`` characters found elsewhere."""
    cold, hot = _sized(occurrences(docs, key, text, length, gram))
    one = cold.withColumn("g", F.col("h")).select("g", "d", "at", "left", "right", "more").repartition("g").sortWithinPartitions("g")
    near = one.mapInPandas(_matches(length, gram, False, False), "d bigint, start bigint, end bigint")

    side = length - gram

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for h, d, at, left, right in zip(batch["h"], batch["d"], batch["at"], batch["left"], batch["right"]):
                around = np.frombuffer((left + "\0" * gram + right).encode("utf-32-le", "surrogatepass"), np.uint32)
                w = window_hashes(around, length)  # the anchor itself is told by h
                out.append(pd.DataFrame({"h": h, "w": w.astype(np.int64), "o": len(left) - np.arange(len(w)), "d": d, "start": at - len(left) + np.arange(len(w))}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("h", "w", "o", "d", "start")})

    each = hot.select("h", "d", F.explode(F.concat(F.array("at"), "more")).alias("at"), "left", "right").mapInPandas(windows, "h bigint, w bigint, o bigint, d bigint, start bigint")
    again = stored(each.groupBy("h", "w", "o").agg(F.min("d").alias("x"), F.max("d").alias("y")).filter("x <> y").select("h", "w", "o", F.lit(True).alias("again")), "again")
    far = _beside(each, again, ["h", "w", "o"]).filter("again").select("d", "start", (F.col("start") + length).alias("end"))
    return merged(near.unionByName(far).distinct()).withColumnRenamed("d", key)


def shared_links(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(key, class_id, n_links)`` of every record with text: the least id of the records with the same text, and how many other
    records have at least ``length`` consecutive characters in common with it. Copies are compared once, by their class, so
    that their pairs are never made. Of several texts of one id the one counts whose class has the least id."""
    rows = docs.select(F.col(key).cast("long").alias("d"), F.col(text).alias("t")).filter("d is not null and t is not null")
    mark = [F.xxhash64("t").alias("x"), F.xxhash64(F.lit(1), "t").alias("y"), F.length("t").alias("n")]
    marked = rows.select("d", *mark).distinct()
    classes = marked.groupBy("x", "y", "n").agg(F.min("d").alias("c"), F.countDistinct("d").alias("size"))
    members = stored(marked.join(classes, ["x", "y", "n"]).groupBy("d").agg(F.min(F.struct("c", "size", "n")).alias("m")).select("d", "m.*"), "members")
    heads = rows.join(members.filter("d = c").select("d"), "d", "left_semi")  # AQE broadcasts it or splits what is skewed
    pairs = shared_pairs(heads, "d", "t", length, gram)
    both = pairs.select(F.col("doc_id_a").alias("c"), F.col("doc_id_b").alias("o")).unionByName(pairs.select(F.col("doc_id_b").alias("c"), F.col("doc_id_a").alias("o")))
    sizes = members.filter("d = c").select(F.col("c").alias("o"), "size")
    linked = both.join(sizes, "o").groupBy("c").agg(F.sum("size").alias("linked"))
    own = F.when(F.col("n") >= length, F.col("size") - 1).otherwise(F.lit(0))
    return members.join(linked, "c", "left").select(F.col("d").alias(key), F.col("c").alias("class_id"), (own + F.coalesce("linked", F.lit(0))).alias("n_links"))


def merged(intervals: DataFrame) -> DataFrame:
    """Overlapping or touching intervals of each ``d`` united."""
    order = Window.partitionBy("d").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return intervals.select("d", "start", "end", island.alias("i")).groupBy("d", "i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("i")


def shared_report(docs: DataFrame, intervals: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_chars, n_spans, shared_chars, shared_part)`` of every record; texts without characters have part 0."""
    sizes = docs.groupBy(key).agg(F.max(F.coalesce(F.length(text), F.lit(0))).alias("n_chars"))
    sums = intervals.groupBy(key).agg(F.count("*").alias("n_spans"), F.sum(F.col("end") - F.col("start")).alias("shared_chars"))
    part = F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0))
    return sizes.join(sums, key, "left").fillna({"n_spans": 0, "shared_chars": 0}).withColumn("shared_part", part)
