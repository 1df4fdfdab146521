"""Declared schemas: ``name,TYPE`` lines, and ``TYPE:name`` header cells."""

from __future__ import annotations

from pyspark.sql import types as T

from tessera.errors import EngineError

TYPES: dict[str, T.DataType] = {
    "INT16": T.ShortType(),
    "INT32": T.IntegerType(),
    "INT64": T.LongType(),
    "INT128": T.DecimalType(38, 0),
    "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "LONGDOUBLE": T.DoubleType(),
    "CHAR": T.StringType(),
    "STRING": T.StringType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampNTZType(),
}


def _field(name: str, kind: str, where: str) -> T.StructField:
    if kind not in TYPES:
        raise EngineError(f"{where}: unknown type {kind!r}")
    if not name:
        raise EngineError(f"{where}: a column without a name")
    return T.StructField(name, TYPES[kind], nullable=False, metadata={"declared": kind})


def parse_schema(text: str) -> T.StructType:
    """``name,TYPE`` per line; blank lines and ``#`` lines are skipped, a trailing comma is allowed."""
    fields = []
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        parts = [p.strip() for p in line.split(",")]
        if len(parts) == 3 and not parts[2]:
            parts.pop()
        if len(parts) != 2:
            raise EngineError(f"line {number}: expected name,TYPE")
        fields.append(_field(*parts, f"line {number}"))
    if not fields:
        raise EngineError("the schema has no columns")
    return T.StructType(fields)


def parse_header(cells: list[str]) -> T.StructType:
    """``TYPE:name`` cells of an inline header."""
    fields = []
    for cell in cells:
        kind, colon, name = cell.strip().partition(":")
        if not colon:
            raise EngineError(f"header cell {cell!r}: expected TYPE:name")
        fields.append(_field(name, kind, f"header cell {cell!r}"))
    return T.StructType(fields)
