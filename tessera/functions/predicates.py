"""Predicates over columns and constants. Null operands give null, which filters drop."""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import EngineError

from .expressions import field_type


class Predicate:
    def resolve(self, schema: T.StructType) -> Column:
        raise NotImplementedError

    def __and__(self, other: Predicate) -> Predicate:
        return And(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Or(self, other)


@dataclass(frozen=True)
class Compare(Predicate):
    column: str
    constant: Any
    how: Callable[[Any, Any], Any]

    def resolve(self, schema: T.StructType) -> Column:
        kind = field_type(schema, self.column)
        constant = F.lit(self.constant)
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            constant = constant.cast(kind)
        return self.how(F.col(self.column), constant)


def Eq(column: str, constant: Any) -> Predicate:
    return Compare(column, constant, operator.eq)


def NotEq(column: str, constant: Any) -> Predicate:
    return Compare(column, constant, operator.ne)


def Greater(column: str, constant: Any) -> Predicate:
    return Compare(column, constant, operator.gt)


def GreaterEq(column: str, constant: Any) -> Predicate:
    return Compare(column, constant, operator.ge)


def Less(column: str, constant: Any) -> Predicate:
    return Compare(column, constant, operator.lt)


def LessEq(column: str, constant: Any) -> Predicate:
    return Compare(column, constant, operator.le)


@dataclass(frozen=True)
class In(Predicate):
    column: str
    constants: Sequence[Any]

    def resolve(self, schema: T.StructType) -> Column:
        field_type(schema, self.column)
        return F.col(self.column).isin(*self.constants)


@dataclass(frozen=True)
class Like(Predicate):
    """SQL LIKE with its wildcards; ``%text%`` becomes a substring test that reaches the scan."""

    column: str
    pattern: str
    negated: bool = False

    def resolve(self, schema: T.StructType) -> Column:
        if not isinstance(field_type(schema, self.column), T.StringType):
            raise EngineError(f"{self.column!r} is no string")
        found = F.col(self.column).like(self.pattern)
        return ~found if self.negated else found


def NotLike(column: str, pattern: str) -> Predicate:
    return Like(column, pattern, negated=True)


@dataclass(frozen=True)
class And(Predicate):
    left: Predicate
    right: Predicate

    def resolve(self, schema: T.StructType) -> Column:
        return self.left.resolve(schema) & self.right.resolve(schema)


@dataclass(frozen=True)
class Or(Predicate):
    left: Predicate
    right: Predicate

    def resolve(self, schema: T.StructType) -> Column:
        return self.left.resolve(schema) | self.right.resolve(schema)
