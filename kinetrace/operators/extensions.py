"""Where user code enters: policies over batches, table functions and grouped aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .filters import contract_report
from .merge import ASKED, KNOTS

Policy = Callable[[dict[str, list]], dict[str, list]]


def with_policy(df: DataFrame, make: Callable[[], Policy], schema: str, expected: dict[str, tuple[str, int | None]] | None = None) -> DataFrame:
    """df with the columns that a policy returns for each batch of rows.

    ``make`` is called once a task, on the executor, so weights are loaded where they are used.  With ``expected`` the
    columns are checked first; what is broken is an error.  A policy that returns another number of rows is an error.
    """
    if expected:
        broken = contract_report(df, expected).collect()
        if broken:
            raise ValueError(f"observations break their contract: {[tuple(r) for r in broken]}")
    added = StructType.fromDDL(schema)
    names, whole = df.columns, StructType(df.schema.fields + added.fields)

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark.sql.pandas.types import to_arrow_type

        policy = make()
        for batch in batches:
            got = policy({n: batch.column(i).to_pylist() for i, n in enumerate(names)})
            if any(len(got[f.name]) != batch.num_rows for f in added.fields):
                raise ValueError("a policy returns one row for each that it gets")
            columns = [pa.array([x.tolist() if isinstance(x, np.ndarray) else x for x in got[f.name]], to_arrow_type(f.dataType)) for f in added.fields]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, *[f.name for f in added.fields]])

    return df.mapInArrow(run, whole)


class Resample:
    """The table function resample(times, dt, start): place and grid time of each sample, gaps repeated, by numpy."""

    def eval(self, times: list[float], dt: float, start: float):
        t = np.asarray(times, float)
        place = np.floor((t - start) / dt + 1e-5).astype(np.int64)
        free = np.concatenate(([0], np.maximum(np.maximum.accumulate(place), -1)[:-1] + 1)) if len(t) else place
        free = np.maximum(free, 0)
        for i in np.flatnonzero(place >= free):
            for g in range(free[i], place[i] + 1):
                yield int(i), g, start + g * dt


def register_functions(spark: SparkSession) -> None:
    """resample for SQL: SELECT * FROM frames, LATERAL resample(times, 0.1, 0.0)."""
    spark.udtf.register("resample", F.udtf(Resample, returnType="sample int, grid long, grid_t double"))


def mixture_quantiles(knots: np.ndarray, weights: np.ndarray) -> list[float]:
    """q01, q02, q98, q99 of a mixture, given (datasets, 6) knots and their weights."""
    p, w = np.array([x for _, x in KNOTS]), weights / weights.sum()
    grid = np.unique(knots)
    if len(grid) == 1:
        return [float(grid[0])] * len(ASKED)
    total = np.zeros(len(grid))
    for row, share in zip(knots, w, strict=True):
        x, first = np.unique(row, return_index=True)
        top = np.append(first[1:], len(row)) - 1
        total += share * np.where(grid >= x[-1], 1.0, np.where(grid < x[0], 0.0, np.interp(grid, x, p[top])))
    total = np.maximum.accumulate(total)
    total[0], total[-1] = 0.0, 1.0
    out = []
    for _, q in ASKED:
        r = int(np.searchsorted(total, q, "left"))
        low, high = total[r - 1], total[r]
        out.append(float(grid[r] if high == low else grid[r - 1] + (q - low) / (high - low) * (grid[r] - grid[r - 1])))
    return out


def merge_quantiles_aggregate():
    """A grouped aggregate (min, q01, q02, q98, q99, max, weight) -> array of q01, q02, q98, q99; a group has a row a dataset."""

    @F.pandas_udf("array<double>")
    def merged(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series, weight: pd.Series) -> list:
        return mixture_quantiles(np.stack([x.to_numpy(float) for x in (a, b, c, d, e, f)], 1), weight.to_numpy(float))

    return merged


def commands(df: DataFrame, chunk: str, joints: list[str], *keys: str) -> DataFrame:
    """One row for each step of a chunk: t and a column for each joint."""
    each = df.select(*keys, F.posexplode(chunk).alias("t", "row_"))
    return each.select(*keys, "t", *[F.col("row_")[i].alias(n) for i, n in enumerate(joints)])


def packed_state(names: list[str]):
    """Scalar columns as one vector, in order."""
    return F.array(*[F.col(f"`{n}`").cast("double") for n in names])


def lists_of(df: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """Rows of a group as one row of lists, in order: a dictionary of lists from a list of dictionaries."""
    held = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("r_"))
    return held.select(group, *[F.col("r_")[c].alias(c) for c in columns])
