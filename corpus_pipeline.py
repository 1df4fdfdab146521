"""From raw documents to token ids in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept. All but the
last return the columns of ``documents``; ``run`` writes each stage as Parquet into the shared folder
and rereads it, so that losing executors never costs more than a stage's missing tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, langid, line_dedup, minhash, mixing
from tessera.llm.common import materialize, shrink_heaps

#: Language identification learns by gradient descent and MinHash, alignment and BPE are no SQL.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn the languages from the labelled folds of ``docs``; documents that the calibrated bar
    rejects go (texts without a letter, of no learned language, or likelier wrong than right)."""
    return langid.accepted(docs, langid.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete the common blocks that an earlier document keeps; documents emptied by that go."""
    return line_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more: one document of each group stays."""
    return minhash.keep_one(docs, words=5, part=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: one row for each copy that the mix takes."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


def lean(stage: Callable) -> Callable:
    """``stage`` without the heap that the one before it left to the executors."""

    @wraps(stage)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shrink_heaps(spark)
        return stage(spark, docs, sf_dir)

    return begin


STAGES = [
    ("language_id", lean(language_id)),
    ("line_dedup", lean(lines)),
    ("minhash_near_dedup", lean(near_duplicates)),
    ("source_mix", lean(mix)),
    ("byte_bpe", lean(tokens)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
