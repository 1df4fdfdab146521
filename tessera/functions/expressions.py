"""Scalar expressions. Each resolves against a schema when a plan is built and becomes a built-in
Spark column, so everything stays inside generated code."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import EngineError

from .patterns import java_pattern, java_replacement

UNITS = ("year", "month", "day", "hour", "minute", "second")


def field_type(schema: T.StructType, name: str) -> T.DataType:
    """Type of a column; the first of several that share the name."""
    for field in schema.fields:
        if field.name == name:
            return field.dataType
    raise EngineError(f"no column {name!r}; there are {', '.join(schema.fieldNames())}")


class Expression:
    name: str

    def resolve(self, schema: T.StructType) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Col(Expression):
    """A column as it is, for CASE branches and ordering."""

    column: str

    @property
    def name(self) -> str:
        return self.column

    def resolve(self, schema: T.StructType) -> Column:
        field_type(schema, self.column)
        return F.col(self.column)


@dataclass(frozen=True)
class Literal(Expression):
    """A constant, of the given Spark type if one is named."""

    name: str
    value: Any
    kind: str | None = None

    def resolve(self, schema: T.StructType) -> Column:
        return F.lit(self.value).cast(self.kind) if self.kind else F.lit(self.value)


@dataclass(frozen=True)
class ExtractMinute(Expression):
    column: str
    output: str | None = None

    @property
    def name(self) -> str:
        return self.output or f"minutes_{self.column}"

    def resolve(self, schema: T.StructType) -> Column:
        if not isinstance(field_type(schema, self.column), (T.TimestampType, T.TimestampNTZType)):
            raise EngineError(f"{self.column!r} is no timestamp")
        return F.minute(self.column)


@dataclass(frozen=True)
class TimeTrunc(Expression):
    """Start of the year, month, day, hour, minute or second; keeps the column's type."""

    column: str
    unit: str
    output: str | None = None

    @property
    def name(self) -> str:
        return self.output or f"date_trunc_{self.column}"

    def resolve(self, schema: T.StructType) -> Column:
        kind = field_type(schema, self.column)
        if self.unit not in UNITS:
            raise EngineError(f"unknown unit {self.unit!r}; units are {', '.join(UNITS)}")
        if isinstance(kind, T.DateType):
            return F.trunc(self.column, self.unit) if self.unit in ("year", "month") else F.col(self.column)
        if not isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            raise EngineError(f"{self.column!r} is neither date nor timestamp")
        return F.date_trunc(self.unit, self.column).cast(kind)


@dataclass(frozen=True)
class Length(Expression):
    """Length in bytes, as bigint."""

    column: str
    output: str | None = None

    @property
    def name(self) -> str:
        return self.output or f"length_{self.column}"

    def resolve(self, schema: T.StructType) -> Column:
        if not isinstance(field_type(schema, self.column), (T.StringType, T.BinaryType)):
            raise EngineError(f"{self.column!r} is no string")
        return F.octet_length(self.column).cast("bigint")


@dataclass(frozen=True)
class AddConst(Expression):
    """Column plus a constant, in the column's own type; a result outside that type raises."""

    column: str
    constant: int | float
    output: str | None = None

    @property
    def name(self) -> str:
        return self.output or f"{self.column}_plus_{self.constant}"

    def resolve(self, schema: T.StructType) -> Column:
        kind = field_type(schema, self.column)
        if not isinstance(kind, T.NumericType):
            raise EngineError(f"{self.column!r} is no number")
        column = F.col(self.column)
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        return (column + F.lit(self.constant)).cast(kind)


@dataclass(frozen=True)
class CaseWhen(Expression):
    """``then`` where the predicate holds, else ``otherwise`` (also where it is null)."""

    name: str
    predicate: Any
    then: Expression
    otherwise: Expression

    def resolve(self, schema: T.StructType) -> Column:
        return F.when(self.predicate.resolve(schema), self.then.resolve(schema)).otherwise(self.otherwise.resolve(schema))


@dataclass(frozen=True)
class RegexpReplace(Expression):
    r"""All matches of a linear-time-dialect pattern replaced; ``\1`` in the replacement is the first group."""

    column: str
    pattern: str
    replacement: str
    output: str | None = None

    @property
    def name(self) -> str:
        return self.output or self.column

    def resolve(self, schema: T.StructType) -> Column:
        if not isinstance(field_type(schema, self.column), T.StringType):
            raise EngineError(f"{self.column!r} is no string")
        pattern, groups = java_pattern(self.pattern)
        return F.regexp_replace(self.column, F.lit(pattern), F.lit(java_replacement(self.replacement, groups)))


@dataclass(frozen=True)
class Cast(Expression):
    """A column as another type; what does not fit raises."""

    column: str
    kind: str
    output: str | None = None

    @property
    def name(self) -> str:
        return self.output or self.column

    def resolve(self, schema: T.StructType) -> Column:
        field_type(schema, self.column)
        return F.col(self.column).cast(self.kind)


@dataclass(frozen=True)
class Round(Expression):
    """A number rounded half up to so many digits after the point."""

    column: str
    digits: int
    output: str | None = None

    @property
    def name(self) -> str:
        return self.output or self.column

    def resolve(self, schema: T.StructType) -> Column:
        if not isinstance(field_type(schema, self.column), T.NumericType):
            raise EngineError(f"{self.column!r} is no number")
        return F.round(self.column, self.digits)
