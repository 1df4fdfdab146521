"""Delimited text against a declared schema into Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessera.errors import EngineError

from .schema import parse_header, parse_schema


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, such as a schema, from any file system Spark reads."""
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, line, value`` of each line. Tasks split files; within a block of a file, ``line``
    rises."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value"
    )


def _odd(value: Column) -> Column:
    """Whether a line has an odd number of quotes: it opens a value that goes on, or closes one."""
    return (F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))) % 2


def _joined(lines: DataFrame) -> DataFrame:
    """``lines`` with those joined to one that a quoted value holds together. A line goes on with the
    one before it if the quotes before it are odd in number: sums over blocks, shifted by the sums of
    the file's earlier blocks, so that no task needs more than a block. A quote that is open at a
    file's end closes there, before a last line feed."""
    lines = lines.withColumn("odd", _odd(F.col("value")))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("file", "block").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("file", "block").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    opened = lines.groupBy("file", "block").agg(F.sum("odd").alias("odds"))
    opened = opened.select("file", "block", (F.coalesce(F.sum("odds").over(earlier), F.lit(0)) % 2).alias("inside"))
    lines = lines.join(opened, ["file", "block"])
    goes_on = (F.col("inside") + F.coalesce(F.sum("odd").over(before), F.lit(0))) % 2
    lines = lines.withColumn("starts", 1 - goes_on).withColumn("nth", F.sum("starts").over(upto))
    skip = lines.groupBy("file", "block").agg(F.sum("starts").alias("records"))
    skip = skip.select("file", "block", F.coalesce(F.sum("records").over(earlier), F.lit(0)).alias("skip"))
    lines = lines.join(skip, ["file", "block"]).withColumn("record", F.col("skip") + F.col("nth"))
    part = F.struct("block", "line", "value")
    whole = lines.groupBy("file", "record").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    value = F.array_join(F.transform("parts", lambda x: x["value"]), "\n")
    whole = whole.select("file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["line"].alias("line"), value.alias("value"))
    return whole.withColumn("value", F.when(_odd(F.col("value")) == 1, F.concat("value", F.lit('"'))).otherwise(F.col("value")))


def _literal(text: str) -> str:
    return "".join(f"\\x{{{ord(c):X}}}" for c in text)


def _values(value: Column, sep: str) -> Column:
    """The values of a record whose quotes are closed. Quotes may open anywhere in a value, a doubled
    one inside them is a quote; blanks before a value and after it go, those after it also from
    quotes. Carriage returns go after quotes are paired. Repetitions are possessive, so that values of
    any length are read without recursion."""
    blanks = "".join(c for c in " \t" if c != sep)
    s = _literal(sep)
    quoted = r'"[^"]*+(?:""[^"]*+)*+"'
    token = rf'[{_literal(blanks)}\r]*+([^"{s}]*+(?:{quoted}[^"{s}]*+)*+){s}'
    bare = lambda x: F.replace(F.regexp_replace(x, r'"([^"]*+(?:""[^"]*+)*+)"', "$1"), F.lit('""'), F.lit('"'))
    some = F.transform(F.regexp_extract_all(F.concat(value, F.lit(sep)), F.lit(token), F.lit(1)), lambda x: F.rtrim(F.translate(F.when(F.contains(x, F.lit('"')), bare(x)).otherwise(x), "\r", ""), F.lit(blanks)))
    plain = F.transform(F.split(F.translate(value, "\r", ""), s, -1), lambda x: F.trim(x, F.lit(blanks)))
    return F.when(F.contains(value, F.lit('"')), some).otherwise(plain)


def _typed(text: Column, field: T.StructField, doubt: str = "") -> Column:
    """A value as its column's type, whatever the session's settings; what does not parse raises, with
    ``doubt`` at the message's end."""
    kind, declared = field.dataType, (field.metadata or {}).get("declared")
    fail = lambda what, to: F.raise_error(F.concat(F.lit(f"{field.name}: {what}: "), text, F.lit(doubt))).cast(to)
    if isinstance(kind, T.StringType):
        return F.when(F.octet_length(text) == 1, text).otherwise(fail("not one byte", "string")) if declared == "CHAR" else text
    shape = {T.DateType: r"\A\d{4}-\d{2}-\d{2}\z", T.TimestampNTZType: r"\A\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\z"}.get(type(kind))
    value = text.try_cast(kind)
    if isinstance(kind, T.DecimalType):  # a cast would round
        shape = r"\A[+-]?\d+\z"
    good = value.isNotNull() if shape is None else value.isNotNull() & text.rlike(shape)
    return F.when(good, value).otherwise(fail(f"no {declared or kind.simpleString()}", kind))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", header: bool = False, multi_line: bool | None = None) -> DataFrame:
    """Rows of delimited text. Quotes may open anywhere in a value and protect separators, line ends
    and doubled quotes; blanks around a value go, carriage returns go everywhere; a missing string
    is empty; a row of another width, a value that does not parse and a CHAR of other than one byte
    raise when read. With ``header`` each file's first row is skipped.

    Files are split among tasks. With ``multi_line`` rows that span lines are joined, which costs
    shuffles and the rows' order; without, a quote that is open at a line's end raises. The lines after
    it may be read by a task that fails first, so then other errors name that cause too. None: one cheap
    pass looks whether any line needs it.
    """
    if len(sep) != 1 or sep in '"\n\r':
        raise EngineError(f"{sep!r} is no separator")
    rows = _lines(spark, path)
    doubt = "" if multi_line is None or multi_line else "; or a quote is not closed in a line before"
    if multi_line is None:
        multi_line = not rows.filter(_odd(F.col("value")) == 1).isEmpty()
    if multi_line:
        rows = _joined(rows)
    else:
        rows = rows.withColumn("value", F.when(_odd(F.col("value")) == 0, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("a quote is not closed: "), "value")).cast("string")))
    if header:
        first = rows.filter("block = 0").groupBy("file").agg(F.min("line").alias("line"))
        rows = rows.join(F.broadcast(first), ["file", "line"], "left_anti")  # a row a file
    width = len(schema.fields)
    values = _values(F.col("value"), sep)
    rows = rows.select("value", values.alias("values"))
    wrong = F.raise_error(F.concat(F.lit(f"not {width} values: "), "value", F.lit(doubt))).cast("array<string>")
    rows = rows.select(F.when(F.size("values") == width, F.col("values")).otherwise(wrong).alias("values"))
    return rows.select(*[_typed(F.col("values")[i], f, doubt).alias(f.name) for i, f in enumerate(schema.fields)])


def read_csv_with_header(spark: SparkSession, path: str, sep: str = ",", multi_line: bool | None = None) -> DataFrame:
    """Delimited text whose first line declares the columns as ``TYPE:name``."""
    first = spark.read.option("lineSep", "\n").text(path).first()
    if first is None:
        raise EngineError("the file is empty")
    line = spark.range(1).select(_values(F.lit(first[0]), sep).alias("cells"))
    return read_csv(spark, path, parse_header(line.first()["cells"]), sep, header=True, multi_line=multi_line)


def convert(spark: SparkSession, source: str, target: str, schema: str | None = None, sep: str = ",", multi_line: bool | None = None) -> None:
    """Delimited text to a Parquet table; ``schema`` is the path of a schema file, else the first
    line declares the columns."""
    if schema is None:
        df = read_csv_with_header(spark, source, sep, multi_line)
    else:
        df = read_csv(spark, source, parse_schema(read_text(spark, schema)), sep, multi_line=multi_line)
    df.write.mode("overwrite").parquet(target)
