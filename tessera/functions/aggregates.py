"""Aggregates. Integer sums are exact: small ones as bigint, bigint ones as decimal(38, 0)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import EngineError

from .expressions import AddConst, field_type

_SMALL = (T.ByteType, T.ShortType, T.IntegerType)


class Aggregate:
    name: str

    def resolve(self, schema: T.StructType) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Count(Aggregate):
    """Rows of a group; of a named column, its non-null values."""

    column: str = "*"
    name: str = "count"

    def resolve(self, schema: T.StructType) -> Column:
        if self.column != "*":
            field_type(schema, self.column)
        return F.count(self.column)


@dataclass(frozen=True)
class Sum(Aggregate):
    """Sum of a column, or of a column plus a constant."""

    of: str | AddConst
    output: str | None = None

    @property
    def name(self) -> str:
        return self.output or f"sum_{self.of if isinstance(self.of, str) else self.of.name}"

    @property
    def column(self) -> str:
        return self.of if isinstance(self.of, str) else self.of.column

    def resolve(self, schema: T.StructType) -> Column:
        kind = field_type(schema, self.column)
        if not isinstance(kind, T.NumericType):
            raise EngineError(f"{self.column!r} is no number")
        column = F.col(self.column) if isinstance(self.of, str) else self.of.resolve(schema)
        if isinstance(kind, T.LongType):
            # decimal(28) has room for 2^63 times the ten digits that Spark's sum adds
            return F.sum(column.cast("decimal(28, 0)")).cast("decimal(38, 0)")
        return F.sum(column)


@dataclass(frozen=True)
class Avg(Aggregate):
    """Average as double; of bigint from an exact sum."""

    column: str
    output: str | None = None

    @property
    def name(self) -> str:
        return self.output or f"avg_{self.column}"

    def resolve(self, schema: T.StructType) -> Column:
        kind = field_type(schema, self.column)
        if not isinstance(kind, T.NumericType):
            raise EngineError(f"{self.column!r} is no number")
        if isinstance(kind, T.LongType):
            total = F.sum(F.col(self.column).cast("decimal(28, 0)")).cast("double")
            return total / F.nullif(F.count(self.column), F.lit(0))
        return F.avg(self.column)


@dataclass(frozen=True)
class _Extreme(Aggregate):
    column: str
    output: str | None = None


class Min(_Extreme):
    @property
    def name(self) -> str:
        return self.output or f"min_{self.column}"

    def resolve(self, schema: T.StructType) -> Column:
        field_type(schema, self.column)
        return F.min(self.column)


class Max(_Extreme):
    @property
    def name(self) -> str:
        return self.output or f"max_{self.column}"

    def resolve(self, schema: T.StructType) -> Column:
        field_type(schema, self.column)
        return F.max(self.column)


@dataclass(frozen=True)
class DistinctCount(Aggregate):
    """Exact number of distinct non-null values."""

    column: str
    output: str | None = None

    @property
    def name(self) -> str:
        return self.output or f"distinct_count_{self.column}"

    def resolve(self, schema: T.StructType) -> Column:
        field_type(schema, self.column)
        return F.count_distinct(self.column)


def small_integer(schema: T.StructType, column: str) -> bool:
    return isinstance(field_type(schema, column), _SMALL)
