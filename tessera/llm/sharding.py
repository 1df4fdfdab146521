"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize

#: Rows of all shards together in one slot bucket; the number of buckets grows with the table.
SLOT_ROWS = 320_000


PRIME = (1 << 31) - 1


def _coefficients(seed: int, shard: int) -> tuple[int, int, int]:
    """The shard's own linear form over the two halves of a key's hash."""
    digest = hashlib.md5(f"{seed}:{shard}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") % (PRIME - 1) + 1 for i in (0, 4, 8))


def key_halves(key: Column) -> tuple[Column, Column]:
    """Two 31-bit numbers from the key's MD5; a null key hashes as a key of its own kind."""
    name = F.md5(F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null")).cast("binary"))
    half = lambda at: F.conv(F.substring(name, at, 8), 16, 10).cast("long") % PRIME
    return half(1), half(9)


def shard_of(x: Column, y: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The shard with the highest score ``w / -ln(u)``, where u in (0, 1) comes from the key's halves
    and the shard's number alone; ties go to the lowest shard. A shard of weight 0 gets nothing.
    Adding a shard moves rows only into it, removing one only out of it."""
    if not weights or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must be non-negative, with a positive one")
    scores = []
    for i, w in enumerate(weights):
        a, b, c = _coefficients(seed, i)
        u = ((x * a % PRIME + y * b % PRIME + c) % PRIME + F.lit(0.5)) / F.lit(float(PRIME))
        scores.append(F.lit(float(w)) / -F.log(u) if w > 0 else F.lit(-1.0))
    scores = F.array(*scores)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def rendezvous_shards(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None, seed: int = 0) -> DataFrame:
    """``df`` with ``shard`` (and ``grown_shard`` under ``grown`` weights). No shuffle; null keys
    share one shard; repeated keys go together; an empty table stays empty. Columns of these names
    are replaced; any others pass through."""
    x, y = key_halves(F.col(key))
    halves = df.select(F.struct("*").alias("row"), x.alias("x"), y.alias("y"))
    made = [shard_of(F.col("x"), F.col("y"), weights, seed).alias("shard")]
    if grown is not None:
        made.append(shard_of(F.col("x"), F.col("y"), grown, seed).alias("grown_shard"))
    kept = [c for c in df.columns if c.lower() not in ("shard", "grown_shard")]
    return halves.select(*[F.col("row").getField(c).alias(c) for c in kept], *made)


def with_slots(df: DataFrame, spread: Column, order: Sequence[str]) -> DataFrame:
    """``df`` (with ``shard``) plus ``slot``, gapless from 0 in each shard.

    No task sees a whole shard: rows fall into buckets by ``spread`` (a non-negative long, even over
    the rows), whose number follows the row count; each bucket numbers its own rows by ``order``,
    and the buckets' running totals shift them. Rows equal in all of ``order`` may swap slots.
    """
    rows = materialize(df, "shard-rows")
    buckets = max(1, -(-rows.count() // SLOT_ROWS))
    rows = rows.withColumn("_bucket", F.pmod(spread, F.lit(buckets)).cast("int"))
    totals = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = F.row_number().over(W.partitionBy("shard", "_bucket").orderBy(*order)) - 1
    numbered = rows.withColumn("_local", local).join(totals, ["shard", "_bucket"])
    return numbered.withColumn("slot", (F.col("_base") + F.col("_local")).cast("long")).drop("_bucket", "_local", "_base")


def op6(spark, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 15 under the law ``key``; ``grown_shard`` has one more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    facts = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = rendezvous_shards(facts, "doc_id", [1.0] * 16, [1.0] * 17)
    # copies of one text and rows that repeat one id both spread over the buckets
    spread = key_halves(F.col("doc_id"))[0] + F.col("text_crc32")
    out = with_slots(placed, spread, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
