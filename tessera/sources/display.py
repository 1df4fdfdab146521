"""Result text: one line per row, a comma after every value."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame


def format_value(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, float):
        return f"{value:.6f}"
    if isinstance(value, datetime.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S")
    return str(value)


def display_lines(df: DataFrame, names: bool = False) -> Iterator[str]:
    """Lines of a result, which comes one partition at a time; without names unless asked for."""
    if names:
        yield "".join(f"{c}," for c in df.columns)
    for row in df.toLocalIterator():
        yield "".join(f"{format_value(v)}," for v in row)
