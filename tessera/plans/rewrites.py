"""Algebra that the optimizer leaves alone, done on our own expressions before Spark sees them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.aggregates import Aggregate, Sum, small_integer
from tessera.functions.expressions import AddConst, Expression, Literal


def split_keys(keys: Sequence[Expression]) -> tuple[list[Expression], list[Expression]]:
    """Keys to group by, and keys that follow from those: constants, and a column plus a constant
    where the column itself is a key. The latter are computed once per group, after grouping."""
    columns = {k.name for k in keys if type(k).__name__ == "Col"}
    follow = [k for k in keys if isinstance(k, Literal) or (isinstance(k, AddConst) and k.column in columns)]
    group = [k for k in keys if k not in follow]
    return (group, follow) if group else (list(keys), [])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def shared_sums(aggregates: Sequence[Aggregate], schema: T.StructType) -> tuple[list[Column], dict[str, str]]:
    """Sums of one small integer column plus different constants need one sum and one count:
    ``sum(x + k) = sum(x) + k * count(x)``. Gives the shared aggregates and, by output name, the
    expressions over them, as text: building columns one by one takes longer than the query. Only for sums whose addends cannot leave bigint; the sum of a column whose
    addition would overflow its own type is thereby exact instead of an error."""
    apart: dict[str, list[Sum]] = {}
    for a in aggregates:
        if isinstance(a, Sum) and isinstance(a.of, AddConst) and isinstance(a.of.constant, int) and small_integer(schema, a.column):
            apart.setdefault(a.column, []).append(a)
    base: list[Column] = []
    made: dict[str, str] = {}
    for column, sums in apart.items():
        if len(sums) < 2:
            continue
        total, count = f"_sum_of_{column}", f"_count_of_{column}"
        base += [F.sum(column).alias(total), F.count(column).alias(count)]
        for s in sums:
            made[s.name] = f"{quoted(total)} + {quoted(count)} * CAST({s.of.constant} AS BIGINT)"
    return base, made
