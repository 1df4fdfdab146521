"""Mixing sources to target weights: equal-token blocks apportioned by Sainte-Laguë.

Documents of a source are split by a stable hash into shards whose number follows its row count;
inside a shard they form one token stream in seeded order, cut into blocks of equal size. The size
follows the smallest target, so that even that is many blocks. Sources get blocks by highest
quotients ``target / (2k + 1)``, a source's blocks go to its shards in the same way by the shards'
block counts, and each shard takes the words of its quota as whole passes over its stream plus a
circular run that starts at a seeded block. Documents stand in random order, so a run is a random
choice of documents, and only the two at its ends are cut.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, materialize, word_count

#: Words of the largest block, and blocks of the smallest target, unless that has fewer words.
BLOCK, LEAST_BLOCKS = 16, 50
#: Sources are a registry, not data: one row of each reaches the driver; more raise.
MOST_SOURCES = 100_000
SHARD_ROWS = 4_000
SEED = 17


def capped_targets(sizes: list[int], weights: list[float], share: float = 1.5, cap: float = 2.0) -> list[float]:
    """``share`` of all sizes split by weight; targets stop at ``cap`` times their size and the
    excess is reshared by weight until none is above."""
    total, out = share * float(sum(sizes)), [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes)) if sizes[i] > 0 and weights[i] > 0]
    left = total
    while open_:
        weight = math.fsum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = cap * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def sainte_lague(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """``seats`` by highest quotients ``votes / (2k + 1)``, at most ``caps`` each; the lower index
    wins ties. The divisor is found by bisection, then the last few seats go one by one."""
    votes, caps = np.asarray(votes, float), np.asarray(caps, np.int64)
    caps = np.where(votes > 0, caps, 0)
    seats = int(min(seats, caps.sum()))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)

    def given(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(votes / divisor + 0.5), caps).astype(np.int64)

    low, high = votes[votes > 0].min() / (2.0 * caps.max() + 4), 4 * votes.max() + 1e-9
    for _ in range(200):
        middle = (low + high) / 2
        if given(middle).sum() >= seats:
            low = middle
        else:
            high = middle
    got = given(high)
    while (rest := seats - int(got.sum())) > 0:
        quotient = np.where(got < caps, votes / (2 * got + 1), -1.0)
        for i in np.argsort(-quotient, kind="stable")[:rest]:
            if got[i] < caps[i]:
                got[i] += 1
    return got


def block_words(targets: list[float], most: int) -> int:
    """Words of a block: at most ``most``, and few enough for the smallest positive target."""
    return max(1, min([most, *(int(t // LEAST_BLOCKS) for t in targets if t > 0)]))


def _shard_quotas(block: int, seed: int) -> Callable:
    def quotas(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("shard", kind="stable").reset_index(drop=True)
        blocks = -(-table["tokens"].to_numpy(np.int64) // block)
        quota = sainte_lague(blocks, int(table["source_quota"].iloc[0]), 2 * blocks)
        draw = [np.random.default_rng([seed, int(s), int(i)]).random() for s, i in zip(table["shard"], table["source_no"])]
        start = np.minimum((np.array(draw) * blocks).astype(np.int64), np.maximum(blocks - 1, 0))
        want = np.minimum(quota * block, 2 * table["tokens"].to_numpy(np.int64))  # the last block may be short
        return pd.DataFrame({
            "source_no": table["source_no"], "shard": table["shard"], "tokens": table["tokens"],
            "want": want, "start": start * block, "source_size": table["source_size"], "target": table["target"],
        })

    return quotas


def _sized(docs: DataFrame) -> DataFrame:
    """Each row whole under ``row``, with the columns the plan needs beside it."""
    text = F.col("text")
    return docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), text.alias("text"),
        word_count(text).alias("size"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("text_hash"),
    )


def shard_plan(sizes: DataFrame, weight_of: Callable[[int], float], share: float, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """One row for each source and shard (tokens, words of its quota, start of the run in words, and
    the source's size and target), and the number of shards of each source. ``sizes`` is read twice,
    so give a written table. One row per source reaches the driver; more than MOST_SOURCES raise."""
    spark = sizes.sparkSession
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).limit(MOST_SOURCES + 1).collect()
    if len(by_source) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    by_source.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    totals = [int(r["size"] or 0) for r in by_source]
    targets = capped_targets(totals, [weight_of(i) for i in range(len(totals))], share)
    block = block_words(targets, block)
    caps = np.array([2 * (-(-s // block)) for s in totals], np.int64)
    quotas = sainte_lague(np.array(targets), round(sum(targets) / block), caps) if totals else np.zeros(0, np.int64)
    shards = spark.createDataFrame(
        [(r["source"], i, -(-r["rows"] // SHARD_ROWS)) for i, r in enumerate(by_source)], "shards_source string, source_no int, shards long"
    )
    facts = spark.createDataFrame(
        [(i, totals[i], float(targets[i]), int(quotas[i])) for i in range(len(by_source))],
        "source_no int, source_size long, target double, source_quota long",
    )
    per_shard = _sharded(sizes, shards, seed).groupBy("source_no", "shard").agg(F.sum("size").alias("tokens"))
    plan = per_shard.join(facts, "source_no").groupBy("source_no").applyInPandas(
        _shard_quotas(block, seed),
        "source_no int, shard int, tokens long, want long, start long, source_size long, target double",
    )
    return materialize(plan, "mix-plan"), shards


def _sharded(docs: DataFrame, shards: DataFrame, seed: int) -> DataFrame:
    """``docs`` with ``source_no`` (never null, so that equal keys stay together) and ``shard``."""
    docs = docs.join(shards, docs["source"].eqNullSafe(shards["shards_source"]))
    return docs.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "text_hash"), F.col("shards")).cast("int"))


def placed(docs: DataFrame, plan: DataFrame, shards: DataFrame, seed: int) -> DataFrame:
    """``docs`` (with ``doc_id, source, size, text_hash``) with what the mix takes of each row:
    ``passes`` whole copies, then the words ``first`` to ``first_end`` and ``second`` to
    ``second_end`` of it, ``taken`` in all. Rows equal in id, size and text may swap places; they are
    all of one shard."""
    order = [F.xxhash64(F.lit(seed + 1), "doc_id", "size", "text_hash"), "doc_id", "size", "text_hash"]
    before = W.partitionBy("source_no", "shard").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = _sharded(docs, shards, seed).withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    out = out.join(plan, ["source_no", "shard"])  # partitioned alike: the rows move once
    n, zero = F.greatest(F.col("tokens"), F.lit(1)), F.lit(0).cast("long")
    at, size, stop = F.col("at"), F.col("size"), F.col("start") + F.col("want") % n
    last = F.least(stop, F.col("tokens"))
    wrap = F.greatest(stop - F.col("tokens"), zero)
    out = out.withColumn("passes", F.floor(F.col("want") / n).cast("long"))
    for name, low, high in (("first", zero, wrap), ("second", F.col("start"), last)):
        low, high = F.greatest(low, at) - at, F.least(high, at + size) - at
        out = out.withColumn(name, F.when(high > low, low).otherwise(zero)).withColumn(f"{name}_end", F.when(high > low, high).otherwise(zero))
    extra = F.col("first_end") - F.col("first") + F.col("second_end") - F.col("second")
    return out.withColumn("taken", (F.col("passes") * size + extra).cast("long"))


def mix_plan(docs: DataFrame, weight_of: Callable[[int], float], share: float = 1.5, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source`` of every row of ``docs`` (``doc_id,
    source, text``); ``block`` bounds a block's words. A source's words are those of its blocks: within
    half a block of its target, where the seats' rounding leaves that. A null source is a source of
    its own, after all others. Null and empty texts take part with nothing; repeated rows are rows of
    their own; an empty table stays empty."""
    sizes = materialize(_sized(docs).drop("row", "text"), "mix-sizes")
    plan, shards = shard_plan(sizes, weight_of, share, block, seed)
    return placed(sizes, plan, shards, seed).select("doc_id", "size", "source_size", "target", "taken", "source")


def contract_weight(i: int) -> float:
    """5, 2, 1, repeating, by the place of a source in code-point order."""
    return (5.0, 2.0, 1.0)[i % 3]


def mixed_documents(docs: DataFrame, weight_of: Callable[[int], float] = contract_weight, share: float = 1.5, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``: one row per copy taken. A document taken whole
    keeps its text; one cut at an end of its shard's run keeps the words taken, in order, with
    single spaces, and ``n_chars``, if there, follows. Rows without words are in no block and left
    out. Columns of any other name pass through."""
    sizes = materialize(_sized(docs).drop("row", "text"), "mix-sizes")
    plan, shards = shard_plan(sizes, weight_of, share, block, seed)
    out = placed(_sized(docs).drop("text"), plan, shards, seed).filter("taken > 0")  # the row has it
    text = F.col("row.text")
    extra, size = F.col("taken") - F.col("passes") * F.col("size"), F.col("size")
    whole = F.array_repeat(text, (F.col("passes") + F.when(extra == size, 1).otherwise(0)).cast("int"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    part = lambda x: F.slice(words, (F.col(x) + 1).cast("int"), (F.col(f"{x}_end") - F.col(x)).cast("int"))
    cut = F.array(F.concat_ws(" ", F.concat(part("first"), part("second"))))
    copies = F.when((extra > 0) & (extra < size), F.concat(whole, cut)).otherwise(whole)
    out = out.select("row", F.explode(copies).alias("copy"))
    row = F.col("row").withField("text", F.col("copy"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("copy").cast(docs.schema["n_chars"].dataType))
    return out.select(row.alias("row")).select("row.*")


def op2(spark, sf_dir: str) -> DataFrame:
    """All documents mixed under the contract's weights, 150 % of all words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_plan(docs, contract_weight)
