"""Shared helpers: shared-folder tables, Arrow text views, hash mixing."""

from __future__ import annotations

import atexit
import ctypes
import weakref
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.scratch import new_path


#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Written tables by the frame that reads them; what is left when the driver ends goes then.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_LEFT: set[str] = set()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back. The table
    outlives any executor. An explicit schema keeps the reread free of inference jobs."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if not _LEFT:
        atexit.register(_remove_left, spark)
    _WRITTEN[out] = path
    _LEFT.add(path)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _LEFT.discard(path)


def _remove_left(spark: SparkSession) -> None:
    try:
        for path in list(_LEFT):
            _remove(spark, path)
    except Exception:  # the session ended first: its folder is the owner's to clear
        return


def discard(*tables: DataFrame) -> None:
    """Remove written tables that no frame still to be run reads."""
    for table in tables:
        if path := _WRITTEN.pop(table, None):
            _remove(table.sparkSession, path)


#: No task gets more than this part of the rows for one key.
PARTS = 4096


def spread_join(rows: DataFrame, facts: DataFrame, on: Sequence[str], spread: Column, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``facts`` on the columns ``on``, where any key may hold most of the rows.

    ``facts`` has one row per key. ``counts``, a written table and ``facts`` itself unless given, has
    ``n``, the number of rows of each of its keys. Keys with more than a PARTS-th of all rows, fewer
    than PARTS of them, are broadcast; such a key's rows are spread by ``spread`` over as many parts
    as keep each below that, and its fact is repeated for each. Only inner and left joins; keys must
    not be null in ``facts``; ``n`` is left out.
    """
    counts = facts if counts is None else counts
    total = counts.agg(F.sum("n")).first()[0] or 0
    parts = F.ceil(F.col("n") * F.lit(float(PARTS)) / F.lit(float(max(1, total)))).cast("int").alias("_parts")
    heavy = F.broadcast(counts.select(*on, parts).filter("_parts > 1"))
    rows = rows.join(heavy, list(on), "left")
    rows = rows.withColumn("_part", F.coalesce(F.pmod(spread, F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    facts = facts.join(heavy, list(on), "left")
    facts = facts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts", "n")
    return rows.join(facts, [*on, "_part"], how).drop("_part")


#: Bits of a sieve: 8 MB, whatever the data's size.
SIEVE_BITS = 1 << 26


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of a fixed size over hashes of a column, in rows of 4 KB."""
    place = F.pmod(F.xxhash64(F.lit(1), key), F.lit(SIEVE_BITS)) + 1
    return keys.select(place.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("_bits"))


def sieved(rows: DataFrame, key: str, of: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean column ``name``: false only where the key is surely none of those in the
    sieve ``of``. It spares a shuffle those rows that have nothing to meet. Where keys are many more
    than bits it spares nothing, and nothing is lost either."""
    place = F.pmod(F.xxhash64(F.lit(1), key), F.lit(SIEVE_BITS)) + 1
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    out = rows.join(F.broadcast(of), F.bitmap_bucket_number(place) == F.col("_bucket"), "left")
    bit = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1))
    return out.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop("_bucket", "_bits")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, ignoring case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text) -> object:
    """Number of words of a text column as long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column without copies; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Row ranges of about ``most`` bytes each, whole rows; a longer row is a range of its own."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(rows, max(stop, start + 1))
        yield start, stop
        start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer over uint64 values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def bounded_batches(spark: SparkSession, megabytes: int = 4) -> None:
    """Arrow batches by bytes, not rows alone, so that very long texts do not pile up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes << 20}b")


def release() -> None:
    """Give memory that this process has freed back to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, with ``release`` before and after each task: workers are kept
    between stages, and what one stage freed would count beside what the next one needs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return task


def shrink_heaps(spark: SparkSession) -> None:
    """Have each executor's JVM collect its garbage, upon which it gives the heap that it no longer
    needs back to the system. Otherwise a heap stays as large as the hungriest stage so far has made
    it, and counts beside the Python workers of the next. One short task per core; an executor that
    is busy with other work may miss it, which costs memory only."""
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).selectExpr("reflect('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()


LONG, DOUBLE, STRING, INT, BOOL, BINARY = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType(), T.BooleanType(), T.BinaryType()
