"""Session settings that results depend on, and settings for a session of our own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Settle what results depend on: truncation of zone-less timestamps goes through the session's
    zone, so it must be UTC, and integer overflow must raise instead of wrapping."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    return spark


def local_session(cores: int | None = None, memory: str = "4g") -> SparkSession:
    """A single-machine session; on a cluster the session is the cluster's own."""
    cores = cores or os.cpu_count() or 1
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tessera")
    settings = {
        "spark.sql.shuffle.partitions": cores,
        "spark.driver.memory": memory,
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return prepare(builder.getOrCreate())
