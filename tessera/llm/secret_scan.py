"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its text. A ledger in a shared folder
holds, for each blob, the rules (name and version) that were run on it and what they found. A scan
runs only the pairs of blob and rule version that the ledger lacks, on one copy of each blob, adds
them to the ledger as a batch of its own, and joins all findings back to all paths. A row of the
ledger is whole for its blob, so a part of a batch that a dying driver leaves is as good as a batch;
pairs scanned twice by scans at the same time give the same findings, which are told once.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessera.sources.scratch import new_path

from .common import materialize, spread_join


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; a match whose ``group`` is shorter than
    ``least`` characters is dropped (it still uses up its text). Raise ``version`` with any change."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: A run of the hex or access alphabet below the least length can hold no longer match, so the
#: least length stands in the pattern, and short runs never become matches.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)

LEDGER = "sha string, rules array<string>, found array<struct<rule: string, start: long, stop: long>>"


def _matches(rule: Rule, text: Column) -> Column:
    """For each match: characters between the one before and it, its length, and whether it counts."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.slice(F.transform(F.split(text, rule.pattern, -1), F.length), 1, F.size(found))
    if rule.group:
        counts = lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least
    else:
        counts = lambda m: F.length(m) >= rule.least
    lengths = F.transform(found, lambda m: F.struct(F.length(m).alias("length"), counts(m).alias("counts")))
    return F.when(F.size(found) > 0, F.arrays_zip(gaps.alias("gap"), lengths.alias("match")))


def read_ledger(spark, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(f"{path}/*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)  # nothing was written yet


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Ledger rows of ``blobs`` (``sha, text, todo``): all rules of ``todo`` run on each text."""
    per_rule = [F.when(F.array_contains("todo", r.name), _matches(r, F.col("text"))).alias(f"m{i}") for i, r in enumerate(rules)]
    # what was found goes through the shared folder once: each text is searched once, whatever reads it
    done = materialize(blobs.select("sha", "todo", *per_rule), "secret-matches")
    spans = None
    for i, rule in enumerate(rules):
        rows = done.filter(F.col(f"m{i}").isNotNull()).dropDuplicates(["sha"])
        rows = rows.select("sha", F.posexplode(f"m{i}").alias("at", "m"))
        upto = W.partitionBy("sha").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
        stop = F.sum(F.col("m").getField("gap") + F.col("m").getField("match")["length"]).over(upto)
        rows = rows.withColumn("stop", stop).filter(F.col("m").getField("match")["counts"])
        rows = rows.select("sha", F.struct(F.lit(rule.name).alias("rule"), (F.col("stop") - F.col("m").getField("match")["length"]).cast("long").alias("start"), F.col("stop").cast("long").alias("stop")).alias("span"))
        spans = rows if spans is None else spans.unionAll(rows)
    found = spans.groupBy("sha").agg(F.collect_list("span").alias("found"))
    scanned = done.select("sha", F.col("todo").alias("rules")).dropDuplicates(["sha"])
    none = F.array().cast(T.ArrayType(found.schema["found"].dataType.elementType))
    return scanned.join(found, "sha", "left").select("sha", "rules", F.coalesce("found", none).alias("found"))


def scan_history(versions: DataFrame, ledger: str, rules: Sequence[Rule] = BASE, path: str = "path", text: str = "text") -> DataFrame:
    """``path, sha, n_<kind>..., spans`` of every row of ``versions``; ``spans`` is an array of
    (start, kind number, kind, stop), sorted, in code points with an exclusive end.

    Null texts are scanned as empty ones. Null paths and repeated rows keep their rows. Other columns
    are not read. An empty table adds nothing to the ledger.
    """
    spark = versions.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    versions = versions.select(F.col(path).alias("path"), body.alias("text"), F.sha2(body.cast("binary"), 256).alias("sha"))
    seen = materialize(versions.select("path", "sha"), "secret-versions")
    known = read_ledger(spark, ledger)
    ran = known.groupBy("sha").agg(F.flatten(F.collect_set("rules")).alias("ran"))
    wanted = F.array(*[F.lit(r.name) for r in rules])
    blobs = materialize(seen.groupBy("sha").agg(F.min("path").alias("rep"), F.count("*").alias("n")), "secret-blobs")
    todo = blobs.drop("n").join(ran, "sha", "left")
    todo = todo.withColumn("todo", F.array_except(wanted, F.coalesce("ran", F.array().cast("array<string>")))).filter(F.size("todo") > 0)
    todo = todo.select(F.col("sha").alias("blob"), "rep", "todo")
    texts = versions.join(todo.hint("shuffle_hash"), (F.col("sha") == F.col("blob")) & F.col("path").eqNullSafe(F.col("rep")))
    scan_blobs(texts.select("sha", "text", "todo"), rules).write.parquet(f"{ledger}/batch-{uuid.uuid4().hex}")

    names = [r.name for r in rules]
    found = read_ledger(spark, ledger).select("sha", F.filter("found", lambda s: s["rule"].isin(names)).alias("found")).filter(F.size("found") > 0)
    number = lambda s: F.array_position(wanted, s["rule"]) - 1
    kind = lambda s: F.element_at(F.split(s["rule"], "@"), 1)
    item = lambda s: F.struct(s["start"].alias("start"), number(s).alias("number"), kind(s).alias("kind"), s["stop"].alias("stop"))
    found = found.select("sha", F.explode("found").alias("s")).select("sha", item(F.col("s")).alias("s"))
    found = found.groupBy("sha").agg(F.array_sort(F.array_distinct(F.collect_list("s"))).alias("spans"))
    out = spread_join(seen, found, ["sha"], F.xxhash64("path"), "left", counts=blobs.select("sha", "n"))  # one blob may have any part of the paths
    spans = F.coalesce("spans", F.array().cast(found.schema["spans"].dataType))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in dict.fromkeys(r.kind for r in rules)]
    return out.withColumn("spans", spans).select("path", "sha", *counts, "spans")


def span_text(spans: str) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def op5(spark, sf_dir: str) -> DataFrame:
    """All documents against an empty ledger of the run's own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ledger = new_path(spark, "secret-ledger")
    out = scan_history(docs, ledger, path="doc_id")
    text = span_text("spans")
    return out.select(
        F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2(text, 256).alias("base_sha256"), text.alias("spans"), F.col("sha").alias("blob_sha256")
    )
