"""The queries of this subpackage; ``oracle_sql`` for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding_dedup, langid, line_dedup, minhash, mixing, mpeg_audio, quality, secret_scan, sharding
from .oracles import oracle_sql

__all__ = ["oracle_sql", "queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.op1,
        "op2_source_mix": mixing.op2,
        "op3_quality_votes": quality.op3,
        "op4_language_id": langid.op4,
        "op5_secret_scan": secret_scan.op5,
        "op6_rendezvous_shards": sharding.op6,
        "op7_minhash_near_dedup": minhash.op7,
        "op8_mpeg_audio": mpeg_audio.op8,
        "op9_embedding_near_dedup": embedding_dedup.op9,
        "op10_byte_bpe": bpe.op10,
    }
