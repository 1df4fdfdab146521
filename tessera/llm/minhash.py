"""MinHash near-duplicates with odd sketches.

1. Every text becomes the set of its word shingles (64-bit hashes), a 128-bit digest of the set, its
   MinHash samples cut into bands, and an odd sketch: a bitmap in which every sample flips one bit.
   The popcount of two sketches' XOR estimates the number of samples that differ, most precisely
   where similarity is high.
2. Texts of equal sets are one class; only classes go on, so copies cost nothing more.
3. Each class is tried against the least class of each of its buckets (linear in the classes); sizes
   and sketches turn away what cannot be near, full sets confirm the rest.
4. Buckets that still hold several components are searched in full: by pairs of blocks, classes of
   different components that sizes and sketches let pass are confirmed on full sets. So no pair that
   shares a bucket is left undecided, and no pair inside a settled component is ever formed.
5. Before full sets move, pairs meet by the parities of their sets: a bitmap in which every shingle
   flips one bit. The popcount of two bitmaps' XOR is never above the number of shingles that only
   one set has, so a pair that it turns away is surely too far; no link is lost.

The number of bands follows from the threshold so that a pair at it misses all buckets with a
probability below MISS. Sketches only turn away pairs far below the threshold (SLACK deviations).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import bounded_batches, discard, materialize, mix64, sieve, sieved, slices, spread_join, tidied, utf8_view
from .components import components

MISS, BANDS, SLACK = 1e-8, 36, 6.0
#: Bits of an odd sketch, in longs of 64.
SKETCH_LONGS = 8
#: Bits of a set's parities, in longs of 64; more turn away larger sets, none turns away a link.
PARITY_LONGS = 16
#: Classes of a bucket in one block; a larger bucket is searched by pairs of blocks.
BLOCK = 256

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1


@dataclass(frozen=True)
class Plan:
    """Shingle length and threshold, and the bands they imply. The similarity bar is ``part`` of 100."""

    words: int
    part: int

    @property
    def rows(self) -> int:
        j, rows = self.part / 100, 1
        while (1 - j ** (rows + 1)) ** BANDS <= MISS:
            rows += 1
        return rows

    @property
    def samples(self) -> int:
        return self.rows * BANDS

    @property
    def most_flipped(self) -> int:
        """Odd sketches that differ in more bits are of pairs far below the threshold: the expected
        popcount at SLACK deviations more differing samples than a pair at the threshold has."""
        k, j, bits = self.samples, self.part / 100, 64 * SKETCH_LONGS
        differ = min(k, k * (1 - j) + SLACK * math.sqrt(k * j * (1 - j)))
        return math.ceil(bits * (1 - (1 - 2 / bits) ** (2 * differ)) / 2 + 1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the rows, A-Z folded, and each row's word offsets."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    letters = np.flatnonzero(inside)
    begin = np.searchsorted(letters, starts)
    lengths = np.diff(np.append(begin, len(letters)))
    place = np.arange(len(letters)) - np.repeat(begin, lengths)
    powers = np.ones(int(lengths.max()), np.uint64)
    np.multiply.accumulate(np.full(len(powers) - 1, _BASE, np.uint64), out=powers[1:])
    values = (_FOLD[data[letters]].astype(np.uint64) + np.uint64(1)) * powers[place]
    hashes = mix64(np.add.reduceat(values, begin) + lengths.astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; fewer words than a shingle are one shingle,
    no words none."""
    hashes, at = word_hashes(data, offsets)
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    for j in range(min(words, n)):
        rolled[: n - j] = rolled[: n - j] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[j:]
    rolled = mix64(rolled + np.uint64(words))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            value = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    value = value * np.uint64(0x165667B19E3779F9) + h
            out.append(mix64(np.array([value], np.uint64)))
        else:
            out.append(hashes[:0])
    return out


def _multipliers(samples: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_011)
    return rng.integers(0, 1 << 31, samples, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, samples, np.uint32)


def min_hashes(sets: list[np.ndarray], samples: int) -> np.ndarray:
    """set x sample: the least of each sample's permutation of the set's folded hashes."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    every = np.concatenate(sets)
    folded = (every >> np.uint64(32)).astype(np.uint32) ^ (every.astype(np.uint32) * np.uint32(0x85EBCA6B))
    out = np.empty((samples, len(sets)), np.uint32)
    mul, add = _multipliers(samples)
    room = np.empty_like(folded)
    for i in range(samples):
        np.multiply(folded, mul[i], out=room)
        np.add(room, add[i], out=room)
        out[i] = np.minimum.reduceat(room, starts)
    return out.T


def band_keys(samples: np.ndarray, rows: int) -> np.ndarray:
    """set x band: one 64-bit key of the band's number and its samples."""
    n = samples.shape[0]
    bands = samples.reshape(n, -1, rows)
    key = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64) + np.uint64(1), bands.shape[:2]).copy()
    for j in range(rows):
        key = mix64(key * np.uint64(_BASE) + bands[:, :, j])
    return key


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """set x SKETCH_LONGS: sample (i, value) flips bit hash(i, value)."""
    n, k = samples.shape
    bits = 64 * SKETCH_LONGS
    spots = mix64(samples.astype(np.uint64) + (np.arange(k, dtype=np.uint64) << np.uint64(34)) + np.uint64(77)) % np.uint64(bits)
    flips = np.bincount((np.arange(n)[:, None] * bits + spots.astype(np.int64)).ravel(), minlength=n * bits) & 1
    return np.packbits(flips.astype(np.uint8).reshape(n, bits), axis=1, bitorder="little").view(np.uint64)


def parities(s: np.ndarray) -> np.ndarray:
    """PARITY_LONGS of a set: every shingle flips bit hash(shingle)."""
    bits = 64 * PARITY_LONGS
    flips = np.bincount((mix64(s + np.uint64(_BASE)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)


def _set_digest(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(s.sum(dtype=np.uint64).view(np.int64)), int(mix64(s * np.uint64(_BASE)).sum(dtype=np.uint64).view(np.int64))


def sketches(docs: DataFrame, plan: Plan) -> DataFrame:
    """``doc_id, text_hash, n_shingles, d0, d1, keys, odd`` of each row of ``docs`` (``doc_id, text``)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def run(batches):
        for batch in batches:
            data, offsets = utf8_view(batch.column(2))
            n = batch.num_rows
            sizes, d0, d1 = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            keys: list = [None] * n
            odd: list = [None] * n
            for start, stop in slices(offsets, 1 << 19):
                sets = shingle_sets(data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start], plan.words)
                some = [i for i, s in enumerate(sets) if len(s)]
                if not some:
                    continue
                samples = min_hashes([sets[i] for i in some], plan.samples)
                for i, k, o in zip(some, band_keys(samples, plan.rows).view(np.int64), odd_sketches(samples).view(np.int64)):
                    row = start + i
                    sizes[row], (d0[row], d1[row]) = len(sets[i]), _set_digest(sets[i])
                    keys[row], odd[row] = k, o
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes), pa.array(d0), pa.array(d1), pa.array(keys, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "d0", "d1", "keys", "odd"],
            )

    longs = T.ArrayType(T.LongType())
    return docs.mapInArrow(tidied(run), T.StructType([
        docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("text_hash", "n_shingles", "d0", "d1")],
        T.StructField("keys", longs), T.StructField("odd", longs),
    ]))


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """``cid, n_shingles, odd, shingles`` (the text's set, sorted longs, its size and parities) of the
    rows of ``docs`` (``cid, d0, d1, text``) whose set has the digest ``d0, d1``."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, offsets = utf8_view(batch.column(3))
            want = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            rows, odd, out = [], [], []
            for start, stop in slices(offsets):
                for i, s in enumerate(shingle_sets(data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start], words)):
                    if _set_digest(s) == want[start + i]:
                        rows.append(start + i)
                        odd.append(parities(s))
                        out.append(s.view(np.int64))
            cids = batch.column(0).take(pa.array(rows, pa.int64()))
            sizes = pa.array([len(s) for s in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [cids, sizes, pa.array(odd, pa.list_(pa.int64())), pa.array(out, pa.list_(pa.int64()))], ["cid", "n_shingles", "odd", "shingles"]
            )

    return docs.select("cid", "d0", "d1", "text").mapInArrow(tidied(run), "cid long, n_shingles long, odd array<long>, shingles array<long>")


def _flipped(odd1: Column, odd2: Column, longs: int) -> Column:
    return sum((F.bit_count(odd1[i].bitwiseXOR(odd2[i])) for i in range(1, longs)), F.bit_count(odd1[0].bitwiseXOR(odd2[0])))


def may_link(plan: Plan, n1: Column, n2: Column, odd1: Column, odd2: Column) -> Column:
    """Whether sizes and odd sketches leave a pair a chance."""
    low, high = F.least(n1, n2), F.greatest(n1, n2)
    flipped = _flipped(odd1, odd2, SKETCH_LONGS)
    return (low * 100 >= high * plan.part) & (flipped <= plan.most_flipped)


def hopeful(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """The ``(u, v)`` of ``pairs`` (a written table) that the parities of their ``sets`` do not rule
    out. With D shingles in one set only and S in both lists together, similarity is (S - D) / (S + D)."""
    met = _fetch(pairs.select("u", "v"), sets.select("cid", "n_shingles", "odd"))
    differ = _flipped(F.col("odd_u"), F.col("odd_v"), PARITY_LONGS).cast("long")
    return met.filter(differ * (100 + plan.part) <= (F.col("n_u") + F.col("n_v")) * (100 - plan.part)).select("u", "v")


def confirmed(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """The ``(u, v)`` of ``pairs`` (a written table) whose full sets are near enough. ``sets`` has
    ``cid, n_shingles, odd, shingles``. A class with many partners is repeated for parts of them."""
    pairs = materialize(hopeful(pairs, sets, plan), "nd-hopeful")
    u = sets.select(F.col("cid").alias("u"), F.col("shingles").alias("s"))
    v = sets.select(F.col("cid").alias("v"), F.col("shingles").alias("t"))
    partners = materialize(pairs.groupBy("u").agg(F.count("*").alias("n")), "nd-partners")
    both = spread_join(pairs.select("u", "v").join(v, "v"), u, ["u"], F.col("v"), counts=partners)
    common = F.size(F.array_intersect("s", "t")).cast("long")
    union = F.size("s") + F.size("t") - common
    return both.filter(common * 100 >= union * plan.part).select("u", "v")


def grouped(docs: DataFrame, plan: Plan) -> DataFrame:
    """``doc_id, text_hash, n_shingles, comp, component_id, n_copies`` of every row; ``comp`` numbers
    the components, null without shingles."""
    docs = docs.select("doc_id", "text")
    rows = materialize(sketches(docs, plan), "nd-sketches")
    # the representative text of a class is one of its least id, or of a null id if it has no other
    text = F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash"))
    classes = rows.filter("n_shingles > 0").groupBy("d0", "d1").agg(
        F.min("doc_id").alias("rep"), text.alias("text_hash"), F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("odd").alias("odd")
    )
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "nd-classes")
    links = class_links(docs, classes, plan)
    linked = components(links)
    comps = linked.select(F.col("u").alias("cid"), F.col("v").alias("comp"))
    named = classes.select("cid", "rep", "d0", "d1", "n").join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    named = materialize(named, "nd-named")
    least = materialize(named.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")), "nd-least")
    named = spread_join(named.select("d0", "d1", "comp", "cid", F.col("n").alias("n_copies")), least, ["comp"], F.col("cid")).select("d0", "d1", "comp", "component_id", "n_copies")
    named = materialize(named.withColumn("n", F.col("n_copies")), "nd-facts")
    discard(classes, links, linked, least)
    own = ["doc_id", "text_hash", "n_shingles", "comp", "component_id", "n_copies"]
    full = spread_join(rows.filter("n_shingles > 0").drop("keys", "odd"), named, ["d0", "d1"], F.xxhash64("doc_id", "text_hash")).select(*own)
    kind = docs.schema["doc_id"].dataType
    bare = rows.filter("n_shingles = 0").select(
        "doc_id", "text_hash", "n_shingles", F.lit(None).cast("long").alias("comp"), F.col("doc_id").cast(kind).alias("component_id"), F.lit(1).cast("long").alias("n_copies")
    )
    return full.unionByName(bare)


def near_duplicates(docs: DataFrame, words: int = 5, part: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, n_copies`` of every row of ``docs`` (``doc_id, text``).

    ``component_id`` is the least doc_id that links reach; rows of equal sets are linked, whatever
    their doc_id. Rows without words have no shingles and are linked with nothing: their component
    is their own id. A null id is above all others and is a component's id only where it holds no
    other; ``kept`` says whether the row's id is the component's (rows that repeat an id are kept or
    not together). An empty table gives no rows. Columns but doc_id and text are not read.
    """
    out = grouped(docs, Plan(words, part))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return out.select("doc_id", "n_shingles", "component_id", kept, "n_copies")


def keep_one(docs: DataFrame, words: int = 5, part: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component: that of the least doc_id, null ids last,
    among those the one of the least text hash. Rows without words all stay. All columns pass
    through. Rows whose id and text need no decision are told by a sieve and do not move."""
    rows = grouped(docs, Plan(words, part)).filter("n_shingles > 0")
    rows = materialize(rows.groupBy("comp", "doc_id", "text_hash", "component_id").agg(F.count("*").alias("n")), "nd-rows")
    first = rows.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("comp").agg(F.min("text_hash").alias("least"))
    first = materialize(rows.groupBy("comp").agg(F.count("*").alias("n")).join(first, "comp"), "nd-first")
    told = spread_join(rows.withColumnRenamed("n", "copies"), first, ["comp"], F.col("text_hash"))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("least"))
    told = told.select(F.xxhash64("doc_id").alias("place"), "text_hash", stays.alias("stays"), F.col("copies").alias("n")).filter("not stays or n > 1")
    told = materialize(told, "nd-told")
    discard(rows, first)
    whole = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id").alias("place"), F.xxhash64("text").alias("text_hash"))
    told, whole = (x.withColumn("spot", F.xxhash64("place", "text_hash")) for x in (told, whole))
    whole, told = sieved(whole, "spot", sieve(told, "spot"), "told").drop("spot"), told.drop("spot")
    met = spread_join(whole.filter("told"), told, ["place", "text_hash"], F.rand(1), "left")
    kept = met.filter("stays is null").select("row").unionAll(whole.filter("not told").select("row"))
    if not told.filter("stays").isEmpty():  # rows that repeat id and text
        kept = kept.unionAll(met.filter("stays").dropDuplicates(["place", "text_hash"]).select("row"))
    return kept.select("row.*")


def class_links(docs: DataFrame, classes: DataFrame, plan: Plan) -> DataFrame:
    """``(u, v)`` class ids that are linked: enough of them to connect all that should be connected."""
    facts = classes.select("cid", "n_shingles", "odd")
    members = classes.select("cid", F.explode("keys").alias("key"))
    leads = materialize(members.groupBy("key").agg(F.min("cid").alias("lead"), F.count("*").alias("n")).filter("n > 1"), "nd-leads")
    members = materialize(spread_join(members, leads, ["key"], F.col("cid")), "nd-buckets")  # only classes that share a bucket

    first = members.filter("cid <> lead").groupBy("cid").agg(F.min("lead").alias("lead"))
    pairs = _fetch(materialize(first.select(F.col("lead").alias("u"), F.col("cid").alias("v")), "nd-first-pairs"), facts)
    pairs = materialize(pairs.filter(may_link(plan, *map(F.col, ("n_u", "n_v", "odd_u", "odd_v")))).select("u", "v"), "nd-pairs")
    near = members.select("cid").distinct()
    reps = materialize(near.join(classes.select("cid", F.xxhash64("rep").alias("place"), "text_hash", "d0", "d1", "n"), "cid"), "nd-reps")
    texts = docs.select(F.xxhash64("doc_id").alias("place"), F.xxhash64("text").alias("text_hash"), "text").withColumn("spot", F.xxhash64("place", "text_hash"))
    texts = sieved(texts, "spot", sieve(reps.select(F.xxhash64("place", "text_hash").alias("spot")), "spot"), "near").filter("near").drop("spot")
    texts = spread_join(texts, reps, ["place", "text_hash"], F.rand(1)).select("cid", "d0", "d1", "text")
    sets = materialize(full_sets(texts, plan.words), "nd-sets")
    if sets.count() != reps.count():  # rows that repeat both id and text
        sets = materialize(sets.dropDuplicates(["cid"]), "nd-sets")
    links = materialize(confirmed(pairs, sets, plan), "nd-links")

    linked = components(links)
    comps = linked.select(F.col("u").alias("cid"), F.col("v").alias("comp"))
    labelled = members.select("key", "cid").join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    labelled = materialize(labelled, "nd-labelled")
    open_ = labelled.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("n")).filter("a <> b").select("key", "n")
    open_ = materialize(open_, "nd-open")
    rows = materialize(spread_join(labelled, open_, ["key"], F.col("cid")).join(facts, "cid"), "nd-rows")
    more = materialize(_block_pairs(rows, plan), "nd-block-pairs")
    more = materialize(confirmed(more, sets, plan), "nd-more")
    out = materialize(links.unionAll(more), "nd-all-links")
    discard(leads, members, pairs, reps, sets, linked, labelled, open_, rows, links, more)
    return out


def _fetch(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """``pairs`` (a written table) with the facts of both; ``u`` may have any number of partners."""
    partners = materialize(pairs.groupBy("u").agg(F.count("*").alias("n")), "nd-partners")
    u, v = (facts.select(F.col("cid").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}")) for x in "uv")
    return spread_join(pairs.join(v, "v"), u, ["u"], F.col("v"), counts=partners)


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (``key, comp, cid, ...``) with ``block`` and, within the bucket's ``total`` blocks, the
    range ``low`` to ``high`` that holds the row's component alone (empty in mixed blocks).

    A component with BLOCK classes or more in a bucket has blocks of its own, so no two of its
    classes ever meet; the smaller ones share mixed blocks, which come first."""
    parts = rows.groupBy("key", "comp").agg(F.count("*").alias("m"), F.count("*").alias("n"))
    parts = materialize(parts.withColumn("own", F.when(F.col("m") >= BLOCK, F.ceil(F.col("m") / F.lit(BLOCK))).otherwise(F.lit(0)).cast("int")), "nd-parts")
    mixed = F.sum(F.when(F.col("own") == 0, F.col("m")).otherwise(F.lit(0)))
    totals = parts.groupBy("key").agg(F.ceil(mixed / F.lit(BLOCK)).cast("int").alias("mixed"), F.sum("own").cast("int").alias("owned"), F.sum("n").alias("n"))
    totals = materialize(totals, "nd-totals")
    before = W.partitionBy("key").orderBy("comp").rowsBetween(W.unboundedPreceding, -1)  # at most 1 / BLOCK of the rows
    large = parts.filter("own > 0").select("key", "comp", "own", F.coalesce(F.sum("own").over(before), F.lit(0)).cast("int").alias("skip"))
    rows = spread_join(rows, totals, ["key"], F.col("cid"))
    rows = spread_join(rows, large, ["key", "comp"], F.col("cid"), "left", counts=parts.select("key", "comp", "n"))
    pure = F.col("own").isNotNull()
    spread = lambda n: F.pmod(F.xxhash64("cid"), n).cast("int")
    low = F.when(pure, F.col("mixed") + F.col("skip")).otherwise(F.lit(0))
    rows = rows.withColumn("low", low).withColumn("high", F.col("low") + F.coalesce("own", F.lit(0))).withColumn("total", F.col("mixed") + F.col("owned"))
    return rows.withColumn("block", F.when(pure, F.col("low") + spread(F.greatest("own", F.lit(1)))).otherwise(spread(F.greatest("mixed", F.lit(1)))))


def _block_pairs(rows: DataFrame, plan: Plan) -> DataFrame:
    """Distinct ``(u, v)`` of one bucket but different components that may link. Each pair of blocks
    that can hold such a pair is one group of the join, and the join's condition turns pairs away
    before they become rows; a settled component's own pairs cost nothing."""
    rows = _blocks(rows)
    pure = F.col("high") > F.col("low")
    none = F.array().cast("array<int>")
    upto = lambda first, last: F.when(first <= last, F.sequence(first, last)).otherwise(none)
    ahead = upto(F.when(pure, F.col("high")).otherwise(F.col("block")), F.col("total") - 1)
    behind = upto(F.lit(0), F.when(pure, F.col("low") - 1).otherwise(F.col("block")))
    left = rows.select("key", F.col("block").alias("b0"), F.explode(ahead).alias("b1"), F.col("cid").alias("x"), F.col("comp").alias("cx"), F.col("n_shingles").alias("nx"), F.col("odd").alias("ox"))
    right = rows.select("key", F.explode(behind).alias("b0"), F.col("block").alias("b1"), F.col("cid").alias("y"), F.col("comp").alias("cy"), F.col("n_shingles").alias("ny"), F.col("odd").alias("oy"))
    pairs = left.join(right, ["key", "b0", "b1"]).filter(
        (F.col("cx") != F.col("cy")) & ((F.col("b0") != F.col("b1")) | (F.col("x") < F.col("y"))) & may_link(plan, *map(F.col, ("nx", "ny", "ox", "oy")))
    )
    return pairs.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def op7(spark, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.85 or more, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, words=3, part=85)
