"""Where queries and their SQL register, and how results are made comparable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Registers a query; views are put in front of its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ctes, _, body = sql.partition("----")
            parts = [*(v.strip() for v in views), *([ctes.strip()] if body else [])]
            ORACLES[f.__name__] = (f"WITH {', '.join(parts)}\n" if parts else "") + (body if body else ctes)
        return f

    return add


def r6(c) -> Column:
    """Six decimals, and no negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def each(df: DataFrame, keys: list[str], array: Column | str, value: str = "x") -> DataFrame:
    return df.select(*keys, F.posexplode(array).alias("i", "x_")).select(*keys, "i", r6("x_").alias(value))


def nums(array: Column) -> Column:
    """Whole numbers of an array as text."""
    return F.concat_ws(",", F.transform(array, lambda x: F.coalesce(x.cast("long").cast("string"), F.lit("-"))))
