"""Named slices of vector columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinetrace.functions.common import must
from kinetrace.schema import Slice

from .blocks import placed


def sliced(column: Column, start: int, end: int) -> Column:
    return F.slice(column, start + 1, end - start)


def as_vector(df: DataFrame, name: str) -> Column:
    """A column as an array of doubles, scalars as one value."""
    column = F.col(f"`{name}`")
    return column.cast("array<double>") if df.schema[name].dataType.typeName() == "array" else F.array(column.cast("double"))


def slice_column(df: DataFrame, spec: Slice, default: str) -> Column:
    """A declared slice: of one column, or of several put together in the given order; unknown columns are errors."""
    names = spec.original_keys or (spec.original_key or default,)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"columns {missing} are missing")
    if spec.is_text:
        return F.coalesce(F.col(f"`{names[0]}`").cast("string"), F.lit(""))
    if df.schema[names[0]].dataType.typeName() == "string":
        return F.col(f"`{names[0]}`")
    return sliced(F.concat(*[as_vector(df, n) for n in names]), spec.start, spec.end)


def select_slices(df: DataFrame, specs: dict[str, Slice], default: str, prefix: str) -> DataFrame:
    return df.select("*", *[slice_column(df, spec, default).alias(f"{prefix}.{key}") for key, spec in specs.items()])


def joined(vectors: list[Column]) -> Column:
    return F.concat(*vectors)


def padded(vector: Column, size: int) -> Column:
    """Zeros up to size; longer vectors are an error."""
    return must(F.size(vector) <= size, F.concat(vector, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(vector))), f"vector of more than {size} values")


def padded_chunk(chunk: Column, dims: int, horizon: int) -> Column:
    rows = F.transform(chunk, lambda row: padded(row, dims))
    return F.concat(rows, F.array_repeat(F.array_repeat(F.lit(0.0), dims), F.lit(horizon) - F.size(chunk)))


def chunk_mask(horizon: Column, dims: int, max_horizon: int, max_dims: int) -> Column:
    """1 where a padded chunk holds values, else 0."""
    line = lambda on: F.concat(F.array_repeat(on, dims), F.array_repeat(F.lit(0.0), max_dims - dims))
    return F.transform(F.sequence(F.lit(0), F.lit(max_horizon - 1)), lambda t: line(F.when(t < horizon, 1.0).otherwise(0.0)))


def split(vector: Column, dims: dict[str, int]) -> dict[str, Column]:
    """A joint vector back into its groups, by prefix sums of their sizes."""
    out, at = {}, 0
    for key, n in dims.items():
        out[key], at = sliced(vector, at, at + n), at + n
    return out


def split_chunk(chunk: Column, dims: dict[str, int], horizon: int) -> dict[str, Column]:
    """The first ``horizon`` rows of a padded chunk, cut into their groups."""

    def part(first: int, n: int) -> Column:
        return F.transform(F.slice(chunk, 1, horizon), lambda row: sliced(row, first, first + n))

    out, at = {}, 0
    for key, n in dims.items():
        out[key], at = part(at, n), at + n
    return out


def nested(df: DataFrame) -> DataFrame:
    """Columns a.b to structs a with fields b."""
    groups: dict[str, list[str]] = {}
    for name in df.columns:
        head, _, tail = name.partition(".")
        groups.setdefault(head, []).append(tail)
    return df.select(*[F.col(f"`{h}`") if tails == [""] else F.struct(*[F.col(f"`{h}.{t}`").alias(t) for t in tails]).alias(h) for h, tails in groups.items()])


def flat(df: DataFrame) -> DataFrame:
    """Structs a with fields b to columns a.b."""
    out = []
    for f in df.schema.fields:
        out += [F.col(f"`{f.name}`.`{x}`").alias(f"{f.name}.{x}") for x in f.dataType.names] if f.dataType.typeName() == "struct" else [F.col(f"`{f.name}`")]
    return df.select(*out)


def reindexed(df: DataFrame, episode: str = "episode", frame: str = "frame") -> DataFrame:
    """Adds new_episode, new_frame and new_index, counted from 0.

    Episodes get their places and starts from ranges of their ids (``placed``), a table of one row per episode; the row index
    adds each episode's start, so no window sees all frames or all episodes.
    """
    sizes = df.groupBy(episode).agg(F.count("*").alias("n_"))
    ranked = placed(sizes, [episode], name="new_episode", sums={"start_": "n_"}).withColumnRenamed(episode, "e_").drop("n_")
    out = df.join(ranked, F.col(episode) == F.col("e_")).withColumn("new_frame", F.row_number().over(W.partitionBy(episode).orderBy(frame)) - 1)
    return out.withColumn("new_index", F.col("start_") + F.col("new_frame")).drop("e_", "start_")
