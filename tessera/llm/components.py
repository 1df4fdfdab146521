"""Connected components over an edge table, by rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One half round. Large star: every neighbour above a node moves to the least of the node and
    its neighbours. Small star: the node and its neighbours below it move to the least of those.
    The minimum is a partial aggregate, so a node of huge degree is one row per task before the
    shuffle; the join back is split by adaptive execution where a node is hot."""
    if small:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        pairs = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    joined = pairs.join(least.select(F.col("u").alias("u0"), F.least("u0", "m").alias("m")), F.col("u") == F.col("u0"))
    if small:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    else:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)``: every node that ``edges`` (long columns ``u, v``) names with another, and the least
    node of its component; the least nodes themselves are left out. Loops and repeated edges do
    nothing; no edges give no rows. Each round is written to the shared folder, and the rounds end
    when a round changes nothing, about log of the longest path; a round's table is removed when the
    next one is written. Only one row of sums a round reaches the driver."""
    edges = materialize(edges.select("u", "v").filter("u <> v").distinct(), "cc-edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first()
        if state == before or not state[0]:
            return edges
        before, old = state, edges
        edges = materialize(_stars(_stars(old, small=False), small=True), "cc-edges")
        discard(old)
