"""Shards, mixtures and their schedule."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .blocks import placed as places
from .blocks import written
from .windows import gathered


def portable_hash(seed: int, *key: Column) -> Column:
    """48 bits of an MD5 digest: a seeded order that any engine reproduces."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def hash_order(seed: int, *key: str) -> Column:
    """A seeded pseudo-random order that any partitioning reproduces."""
    return portable_hash(seed, *[F.col(k) for k in key])


def piece(order: Sequence[Column | str], splits: int, episode: str = "episode") -> Column:
    """Which of ``splits`` pieces of its episode a step falls into: every splits-th in a given order."""
    return F.pmod(F.row_number().over(W.partitionBy(episode).orderBy(*order)) - 1, F.lit(splits)).cast("int")


#: Episodes whose pieces one task places greedily; those of more are dealt out by their rank.
BLOCK = 20_000


def shard_plan(anchors: DataFrame, size: int, rate: float, seed: int = 0, episode: str = "episode", frame: str = "frame", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(anchors with piece and shard, shard lengths).

    Episodes are cut into int(1 / rate) pieces; each piece, in shuffled order of episodes, goes to the shard that is
    emptiest so far.  That greedy step is sequential, so one task takes it, for ``block`` episodes at most.  Pieces of more
    episodes are ranked by size, then by that order, and dealt round the shards.  Either way there are as many shards as
    ``size`` asks for in all, and no two are further apart than the largest piece: of ranks dealt round, what one shard has
    more than another is a sum over disjoint stretches of the sizes' descent.  A shard that stays empty is an error.
    """
    splits = max(1, int(1 / rate))
    own = anchors.withColumn("piece", piece([hash_order(seed, episode, frame), frame], splits, episode))
    sizes = own.groupBy(episode, "piece").agg(F.count("*").alias("n"))
    sizes = written(sizes.select(F.col(episode).alias("e_"), F.col("piece").alias("p_"), "n", hash_order(seed + 1, episode).alias("o")), "pieces")
    n, pieces, total = sizes.agg(F.countDistinct("e_"), F.count("*"), F.sum("n")).first()
    kind = anchors.schema[episode].dataType.simpleString()

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("o", "ascending"), ("e_", "ascending"), ("p_", "ascending")])
        counts = table.column("n").to_pylist()
        episodes = len(set(table.column("e_").to_pylist()))
        shards = min(max(1, math.ceil(sum(counts) / size)), episodes * splits)
        heap, placed = [(0, i) for i in range(shards)], []
        for x in counts:
            held, i = heapq.heappop(heap)
            placed.append(i)
            heapq.heappush(heap, (held + x, i))
        if any(held == 0 for held, _ in heap):
            raise ValueError("a shard is empty")
        return table.select(["e_", "p_", "n"]).append_column("shard", pa.array(placed, pa.int32()))

    if n <= block:
        placed = sizes.withColumn("block", F.lit(0)).groupBy("block").applyInArrow(place, f"e_ {kind}, p_ int, n long, shard int")
    else:
        shards = min(max(1, math.ceil(total / size)), n * splits)
        if pieces < shards:
            raise ValueError("a shard is empty")
        ranked = places(sizes, [-F.col("n"), "o", "e_", "p_"], name="rank_")
        placed = ranked.select("e_", "p_", "n", (F.col("rank_") % shards).cast("int").alias("shard"))
    lengths = placed.groupBy("shard").agg(F.sum("n").alias("length"))
    # Files of anchors hold many rows a byte, so by their size Spark would gather millions of them at the driver to broadcast.
    return own.join(placed.select("e_", "p_", "shard").hint("merge"), (F.col(episode) == F.col("e_")) & (F.col("piece") == F.col("p_"))).drop("e_", "p_"), lengths


def shuffled(df: DataFrame, seed: int, shard: str = "shard", key: Sequence[str] = ("episode", "frame"), name: str = "place") -> DataFrame:
    """Adds each row's place within its shard, in a seeded order."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(shard).orderBy(hash_order(seed, *key), *key)) - 1)


def dataset_weights(datasets: DataFrame) -> DataFrame:
    """weight: a dataset's share of its group's shards times the group's mix ratio (dataset, grp, shards, mix_ratio)."""
    return datasets.withColumn("weight", F.col("shards") / F.sum("shards").over(W.partitionBy("grp")) * F.col("mix_ratio"))


def schedule(datasets: DataFrame, draws: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """draw, dataset, cycle, shard: draws with probability in proportion to weight / mean shard length.

    datasets has (dataset, weight, mean_length, shards), a row each.  A dataset's shards are cycled without replacement,
    reshuffled each time they are used up.  An epoch's schedule is that of seed + epoch; a run that is resumed at a step
    takes seed + step.  Draws meet the cumulative weights by conditions over the collected table of datasets.
    """
    seed = seed + epoch
    rows = sorted(datasets.collect(), key=lambda r: r.dataset)
    p = [r.weight / r.mean_length for r in rows]
    if not rows or min(p) < 0 or sum(p) <= 0:
        raise ValueError("weights must be 0 or more with a sum above 0")
    u = (portable_hash(seed, F.col("draw")) + 0.5) / float(1 << 48)
    at, pick = 0.0, None
    for r, x in zip(rows, p, strict=True):
        at += x / sum(p)
        test = F.col("u") < at if r is not rows[-1] else F.lit(True)
        value = F.struct(F.lit(r.dataset).alias("dataset"), F.lit(r.shards).alias("shards"))
        pick = F.when(test, value) if pick is None else pick.when(test, value)
    drawn = datasets.sparkSession.range(draws).withColumnRenamed("id", "draw").withColumn("u", u).withColumn("d", pick).select("draw", "d.*")
    drawn = drawn.withColumn("k", F.row_number().over(W.partitionBy("dataset").orderBy("draw")) - 1).withColumn("cycle", F.floor(F.col("k") / F.col("shards")).cast("int")).withColumn("turn", F.col("k") % F.col("shards"))
    decks = drawn.groupBy("dataset", "cycle", "shards").agg(F.lit(1).alias("one")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards").cast("int") - 1)))
    order = portable_hash(seed + 1, F.col("dataset"), F.col("cycle"), F.col("shard"))
    decks = decks.withColumn("turn", F.row_number().over(W.partitionBy("dataset", "cycle").orderBy(order, "shard")) - 1)
    return drawn.join(decks.select("dataset", "cycle", "turn", "shard"), ["dataset", "cycle", "turn"]).select("draw", "dataset", "cycle", "shard")


def evaluation_schedule(datasets: DataFrame) -> DataFrame:
    """draw, dataset, shard: every shard of every dataset once, in order."""
    each = datasets.select("dataset", F.explode(F.sequence(F.lit(0), F.col("shards").cast("int") - 1)).alias("shard"))
    before = F.coalesce(F.sum("shards").over(W.orderBy("dataset").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = datasets.select(F.col("dataset").alias("d_"), before.alias("first_"))
    return each.join(first, F.col("dataset") == F.col("d_")).select((F.col("first_") + F.col("shard")).cast("long").alias("draw"), "dataset", "shard")


def mixture_summary(datasets: DataFrame) -> DataFrame:
    """dataset, tag, length, mix_percent: what a mixture consists of."""
    share = F.col("weight") / F.sum("weight").over(W.partitionBy()) * 100
    return datasets.select("dataset", "tag", F.col("shards").alias("length"), share.alias("mix_percent"))


def worker_split(df: DataFrame, index: str, world: int, workers: int) -> DataFrame:
    """rank and worker of each row: index modulo world * workers."""
    at = F.pmod(F.col(index), F.lit(world * workers))
    return df.withColumn("rank", F.floor(at / workers).cast("int")).withColumn("worker", (at % workers).cast("int"))


def shard_balance(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.sum("length").alias("total"), F.avg("length").alias("mean"), F.stddev_pop("length").alias("std"))


def write_shards(df: DataFrame, path: str, shard: str = "shard", shards: int | None = None) -> None:
    """One folder per shard, rows of a shard together."""
    n = shards or df.select(shard).distinct().count()
    df.repartitionByRange(n, shard).write.partitionBy(shard).mode("overwrite").parquet(path)


def shard_samples(plan: DataFrame, frames: DataFrame, shard: int | None, states: Sequence[str], actions: Sequence[str], state_offsets: Sequence[int], action_offsets: Sequence[int], *, text: str | None = None, seed: int = 0, episode: str = "episode", frame: str = "frame") -> DataFrame:
    """The samples of a shard, or of all: states and actions (maps of key to rows), text and place, one row an anchor.

    Only frames of the shard's episodes are read on, windows are one sort an episode, and rows come in the shard's order.
    """
    picked = plan if shard is None else plan.where(F.col("shard") == shard)
    picked = shuffled(picked, seed, key=(episode, frame)).select(F.col(episode).alias("e_"), F.col(frame).alias("f_"), "shard", "place")
    own = frames.join(picked.select("e_").distinct(), F.col(episode) == F.col("e_"), "left_semi")
    for kind, keys, offsets in (("state", states, state_offsets), ("action", actions, action_offsets)):
        rows = [gathered(F.col(f"`{kind}.{k}`"), offsets, episode=episode, frame=frame) for k in keys]
        own = own.withColumn(f"{kind}s", F.create_map(*[x for k, r in zip(keys, rows, strict=True) for x in (F.lit(k), r)]))
    out = own.join(picked, (F.col(episode) == F.col("e_")) & (F.col(frame) == F.col("f_")))
    return out.select("shard", "place", episode, frame, "states", "actions", *([F.col(text).alias("text")] if text else []))
