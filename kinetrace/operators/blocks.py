"""Ordered work over groups of any length: places without a global window, blocks with halos, and values carried over blocks.

An episode may be endless, and a table one episode.  Places come from ranges of the order and counts of each range.  Windows
of bounded reach run within blocks of an episode that also hold their neighbours' rows within reach.  Running values run
within blocks, beginning with what the blocks before (or after) amount to.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinetrace.sources.storage import shared_folder

#: Rows of a block.
BLOCK = 4096


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: what follows sees the same rows in the same partitions' order."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _before(spans: DataFrame, keys: Sequence[str], totals: Sequence[str]) -> DataFrame:
    """The totals of a group's earlier tasks, for each task and group; of a single group, for as many rows as there are tasks,
    on the driver."""
    if keys:
        w = W.partitionBy(*keys).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
        return spans.select(*[F.col(k).alias(f"{k}_k") for k in keys], F.col("part_").alias("part_k"), "first_", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_before") for c in totals])
    rows, held = [], {c: 0 for c in totals}
    for row in sorted(spans.collect(), key=lambda r: r["part_"]):
        rows.append((row["part_"], row["first_"], *held.values()))
        held = {c: held[c] + (row[c] or 0) for c in totals}
    schema = ", ".join([f"part_k {spans.schema['part_'].dataType.simpleString()}", "first_ long", *[f"{c}_before {spans.schema[c].dataType.simpleString()}" for c in totals]])
    return spans.sparkSession.createDataFrame(rows, schema)


def placed(df: DataFrame, order: Sequence[Column | str], keys: Sequence[str] = (), *, name: str = "place", sums: Mapping[str, str] | None = None) -> DataFrame:
    """Adds each row's place, from 0, in the order of its group, and for each of ``sums`` (name: column) the sum over rows before.

    Rows are dealt out by ranges of keys and order, null first, sorted in their tasks and written.  A row's place is its
    place in its task plus the group's rows in tasks before: one row for each task and group is all that a window orders.
    Rows that are equal in keys and order come in any order.
    """
    sums, spark = sums or {}, df.sparkSession
    by = [f"by{i}_" for i in range(len(order))]
    # The last key spreads rows that are equal in all others.
    own = df.select("*", *[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(order, by, strict=True)], F.monotonically_increasing_id().alias("tie_"))
    ranges = [F.col(c).asc_nulls_first() for c in (*keys, *by, "tie_")]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = own.repartitionByRange(parts, *ranges).sortWithinPartitions(*ranges)
    # A row's number is its task's number, times 2^33, and its place there.
    dealt = written(dealt.drop(*by, "tie_").withColumn("at_", F.monotonically_increasing_id()), "placed").withColumn("part_", F.shiftright("at_", 33))
    spans = dealt.groupBy(*keys, "part_").agg(F.min("at_").alias("first_"), F.count("*").alias("n_"), *[F.sum(c).alias(f"{s}_of") for s, c in sums.items()])
    held = _before(spans, keys, ["n_", *[f"{s}_of" for s in sums]])
    # Of a single group there is a row a task; its size is unknown to Spark, which would rather broadcast the dealt rows.
    held = held if keys else F.broadcast(held)
    same = F.col("part_") == F.col("part_k")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_k"))
    out = dealt.join(held, same).withColumn(name, F.col("n__before") + F.col("at_") - F.col("first_"))
    within = W.partitionBy(*keys, "part_").orderBy("at_").rowsBetween(W.unboundedPreceding, -1)
    for s, c in sums.items():
        out = out.withColumn(s, F.col(f"{s}_of_before") + F.coalesce(F.sum(c).over(within), F.lit(0)))
    return out.select(*df.columns, name, *sums)


def block_of(frame: str, size: int) -> Column:
    return F.floor(F.col(frame) / size)


def haloed(df: DataFrame, low: int, high: int, size: int = BLOCK, *, frame: str = "frame") -> DataFrame:
    """Adds block_ and own_: each row in its block of ``size`` frames (own_), and copies of it in other blocks with anchors that
    see it at an offset from ``low`` to ``high``.

    Frames must be the rows' places in their episode, from 0 without gaps (``placed`` gives them).  An anchor's block then holds
    all rows within its reach, and ends short only where the episode does; windows over it are those over the episode.
    """
    if low > 0 or high < 0:
        raise ValueError("an anchor sees itself: low <= 0 <= high")
    first, last = F.floor((F.col(frame) - high) / size), F.floor((F.col(frame) - low) / size)
    out = df.withColumn("block_", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return out.withColumn("own_", F.col("block_") == block_of(frame, size))


def carried(df: DataFrame, values: Mapping[str, tuple[Column, Callable[[Column], Column]]], keys: Sequence[str], block: str = "block_", *, after: bool = False) -> DataFrame:
    """df with, for each name, an aggregate (F.max, F.min, F.sum) of a column over all earlier blocks of the group, or all later ones.

    Null where there is no such block.  Aggregates of aggregates are running values, so only one row a block is ordered.
    """
    each = df.groupBy(*keys, block).agg(*[f(c).alias(n) for n, (c, f) in values.items()])
    w = W.partitionBy(*keys).orderBy(block)
    w = w.rowsBetween(1, W.unboundedFollowing) if after else w.rowsBetween(W.unboundedPreceding, -1)
    held = each.select(*[F.col(k).alias(f"{k}_k") for k in (*keys, block)], *[f(F.col(n)).over(w).alias(n) for n, (_, f) in values.items()])
    same = F.lit(True)
    for k in (*keys, block):
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_k"))
    return df.join(held, same, "left").drop(*[f"{k}_k" for k in (*keys, block)])
