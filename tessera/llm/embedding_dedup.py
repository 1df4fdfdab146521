"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines inside
buckets, connected components over the links.

Bits per table follow the number of distinct vectors, so buckets keep their size, and the number of
tables follows the bits, so that a pair at the threshold shares no bucket with a probability below
MISS. Buckets first hold ids and 128 further signs only: a vector goes to a bucket's exact comparison
if some other there differs in few of those signs (SLACK deviations beyond what a pair at the
threshold shows). Exact cosines are matrix products over blocks of a bucket; a pair counts only in
the first table in which it meets, so counts need no list of pairs, and a block sends on one row per
linked vector.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, spread_join
from .components import components

MISS, BUCKET, BLOCK, SEED = 1e-6, 64, 1024, 90_001
SIGNS, SLACK = 128, 7.0


def tables_for(distinct: int, cosine: float) -> tuple[int, int]:
    """Bits per table and number of tables for so many distinct vectors."""
    bits = min(30, max(4, math.ceil(math.log2(max(1, distinct) / BUCKET)) if distinct > BUCKET else 4))
    agree = (1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi) ** bits
    return bits, 1 if agree >= 1 else math.ceil(math.log(MISS) / math.log1p(-agree))


def most_different(cosine: float) -> int:
    """Signs in which a pair at the threshold or nearer may differ."""
    p = math.acos(min(1.0, max(-1.0, cosine))) / math.pi
    return math.floor(SIGNS * p + SLACK * math.sqrt(SIGNS * p * (1 - p)))


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    at = column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def _codes(bits: int, tables: int):
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(bits)).astype(np.int64)
        for batch in batches:
            vectors = _matrix(batch.column(1))
            out, apart = np.zeros((len(vectors), tables), np.int64), np.zeros((len(vectors), 2), np.int64)
            lengths = np.array([len(v) for v in vectors])
            for dim in np.unique(lengths).tolist():
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, dim]).standard_normal((dim, SIGNS + bits * tables))
                rows = np.flatnonzero(lengths == dim)
                signs = _unit(np.stack([vectors[i] for i in rows])) @ planes[dim] >= 0
                out[rows] = signs[:, SIGNS:].reshape(len(rows), tables, bits) @ weights
                apart[rows] = np.packbits(signs[:, :SIGNS], axis=1, bitorder="little").view(np.int64)
            codes = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * tables), pa.array(out.ravel().astype(np.int32)))
            signs = [pa.array(np.ascontiguousarray(apart[:, i])) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, codes, *signs], ["cid", "embedding", "n_copies", "codes", "s0", "s1"])

    return run


def local_roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index that links reach from each of ``size`` nodes, for links (a, b)."""
    root = np.arange(size)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _block_links(table: int, same: bool, cid, copies, codes, vectors, blocks, first_block: int, cosine: float):
    """Linked vectors of one pair of blocks: id, linked copies, and the least id of its local group."""
    left, right = (np.arange(len(cid)),) * 2 if same else (np.flatnonzero(blocks == first_block), np.flatnonzero(blocks != first_block))
    if not len(left) or not len(right):
        return None
    unit = _unit(vectors)
    near = unit[left] @ unit[right].T >= cosine
    if same:
        near = np.triu(near, 1)
    a, b = np.nonzero(near)
    a, b = left[a], right[b]
    if table and len(a):
        new = np.concatenate([~(codes[a[i : i + 65536], :table] == codes[b[i : i + 65536], :table]).any(1) for i in range(0, len(a), 65536)])
        a, b = a[new], b[new]
    if not len(a):
        return None
    links = np.bincount(a, copies[b], len(cid)) + np.bincount(b, copies[a], len(cid))
    order = np.argsort(cid)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(cid))
    root = order[local_roots(len(cid), rank[a], rank[b])[rank]]
    some = np.flatnonzero(links > 0)
    return cid[some], links[some].astype(np.int64), cid[root[some]]


def _groups(batches):
    """Rows of one (table, code, dim, pair of blocks), as sorted; such a run may span batches."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy() for i in range(5)])
        cuts = (np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            now = tuple(key[:, a].tolist())
            if held and now != held_key:
                yield held_key, held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held_key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield held_key, held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _flush(parts: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), f.type) for x, f in zip(zip(*parts), schema)], schema=schema)


def _promising(most: int):
    """Rows of a group that differ from some other row of it in at most ``most`` signs."""

    def run(batches):
        schema = pa.schema([(c, pa.int32()) for c in ("t", "code", "dim", "b0", "b1", "block")] + [("cid", pa.int64())])
        parts, size = [], 0
        for (_, _, _, b0, b1), rows in _groups(batches):
            if rows.num_rows < 2:
                continue
            block = rows.column(5).to_numpy()
            s0, s1 = (rows.column(i).to_numpy().view(np.uint64) for i in (7, 8))
            left = np.arange(len(block)) if b0 == b1 else np.flatnonzero(block == b0)
            right = left if b0 == b1 else np.flatnonzero(block != b0)
            differ = np.bitwise_count(s0[left, None] ^ s0[right]).astype(np.int16) + np.bitwise_count(s1[left, None] ^ s1[right])
            if b0 == b1:
                np.fill_diagonal(differ, SIGNS)
            near = differ <= most
            some = np.union1d(left[near.any(1)], right[near.any(0)])
            if len(some):
                parts.append(tuple(rows.column(i).to_numpy()[some] for i in range(7)))
                size += len(some)
            if size > 50_000:
                yield _flush(parts, schema)
                parts, size = [], 0
        if parts:
            yield _flush(parts, schema)

    return run


def _search(cosine: float):
    """Exact links of each group."""

    def run(batches):
        schema = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
        parts, size = [], 0
        for (table, _, _, b0, b1), rows in _groups(batches):
            if rows.num_rows < 2:
                continue
            blocks, cid, copies = (rows.column(i).to_numpy() for i in (5, 6, 7))
            codes, vectors = np.stack(_matrix(rows.column(8))), np.stack(_matrix(rows.column(9)))
            found = _block_links(table, b0 == b1, cid, copies, codes, vectors, blocks, b0, cosine)
            if found:
                parts.append(found)
                size += len(found[0])
            if size > 20_000:
                yield _flush(parts, schema)
                parts, size = [], 0
        if parts:
            yield _flush(parts, schema)

    return run


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null or empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, cosine: float = 0.95, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``key, n_links, component_id, kept`` of every row: the number of other rows at ``cosine`` or
    nearer, the least key that links reach, and whether that is the row's own.

    Equal vectors are one class that is compared once and counted by its copies. Vectors that are
    null, empty, zero or hold nulls, NaN or infinities link with nothing and are their own
    component; vectors of different lengths do not link. Rows that repeat a key are vectors of
    their own. A null key is above all others. An empty table gives no rows; other columns are
    not read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(
        F.col(key).alias("key"), F.col(embedding).alias("embedding"), usable(F.col(embedding)).alias("ok"),
        F.xxhash64(embedding).alias("h0"), F.xxhash64(F.lit(1), embedding).alias("h1"),
    )
    classes = rows.filter("ok").groupBy("h0", "h1").agg(F.min("key").alias("rep"), F.count("*").alias("n_copies"), F.first("embedding").alias("embedding"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "ed-classes")
    bits, tables = tables_for(classes.count(), cosine)
    element = classes.schema["embedding"].dataType.elementType.simpleString()
    coded = classes.select("cid", "embedding", "n_copies").mapInArrow(
        _codes(bits, tables), f"cid long, embedding array<{element}>, n_copies long, codes array<int>, s0 long, s1 long"
    )
    coded = materialize(coded, "ed-coded")
    thin = coded.select("cid", "s0", "s1", F.size("embedding").alias("dim"), F.posexplode("codes").alias("t", "code"))
    buckets = thin.groupBy("t", "code", "dim").agg(F.count("*").alias("n")).filter("n > 1")
    members = thin.join(buckets, ["t", "code", "dim"])
    members = members.withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = ["t", "code", "dim", "b0", "b1"]
    members = members.select("t", "code", "dim", F.least("block", "other").alias("b0"), F.greatest("block", "other").alias("b1"), "block", "cid", "s0", "s1")
    members = members.repartition(*group).sortWithinPartitions(*group).mapInArrow(
        _promising(most_different(cosine)), "t int, code int, dim int, b0 int, b1 int, block int, cid long"
    )
    promising = materialize(members, "ed-promising")
    members = promising.join(coded.select("cid", "n_copies", "codes", "embedding"), "cid")
    members = members.select(*group, "block", "cid", "n_copies", "codes", "embedding")
    found = members.repartition(*group).sortWithinPartitions(*group).mapInArrow(_search(cosine), "cid long, links long, root long")
    found = materialize(found, "ed-links")
    linked = components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    comps = linked.select(F.col("u").alias("cid"), F.col("v").alias("comp"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.select("cid", "rep", "n_copies", "h0", "h1").join(links, "cid", "left").join(comps, "cid", "left")
    named = materialize(named.withColumn("comp", F.coalesce("comp", "cid")), "ed-named")
    least = materialize(named.groupBy("comp").agg(F.min("rep").alias("least"), F.count("*").alias("n")), "ed-least")
    named = spread_join(named, least, ["comp"], F.col("cid")).select(
        "h0", "h1", (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("links"), "least", F.col("n_copies").alias("n")
    )
    named = materialize(named, "ed-facts")
    discard(classes, coded, promising, found, linked, least)
    # copies of one vector may be any part of the rows
    full = spread_join(rows.filter("ok").select("key", "h0", "h1"), named, ["h0", "h1"], F.xxhash64("key")).select("key", "links", F.col("least").alias("own"))
    bare = rows.filter("not ok").select("key", F.lit(0).cast("long").alias("links"), F.col("key").alias("own"))
    out = full.unionByName(bare)
    return out.select(F.col("key").alias(key), F.col("links").cast("long").alias("n_links"), F.col("own").alias("component_id"), F.col("key").eqNullSafe(F.col("own")).alias("kept"))


def op9(spark, sf_dir: str) -> DataFrame:
    """All embeddings at cosine 0.95."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
