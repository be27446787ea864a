"""Small pieces of Column arithmetic."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: keeps nested formulas linear in size."""
    return F.transform(F.array(value), body)[0]


def doubles(column: Column) -> Column:
    return column.cast("array<double>")


def items(column: Column, n: int, start: int = 0) -> list[Column]:
    return [column[i] for i in range(start, start + n)]


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def must(condition: Column, value: Column, message: str) -> Column:
    """value where condition holds, else an error when the row is evaluated."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))


def at_length(column: Column, n: int, what: str) -> Column:
    return must(F.size(column) == n, column, f"{what} needs {n} values")
