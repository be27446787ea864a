"""Horizon windows over the frames of episodes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .blocks import block_of, carried, haloed, placed


def within(episode: str | Sequence[str]):
    """Windows over an episode, or over what several keys tell apart."""
    return W.partitionBy(*([episode] if isinstance(episode, str) else episode))


def frames(episode: str | Sequence[str] = "episode", frame: str = "frame"):
    return within(episode).orderBy(frame)


def gathered(value: Column | str, offsets: Sequence[int], *, pad: bool = False, episode: str | Sequence[str] = "episode", frame: str = "frame") -> Column:
    """Array of a value at anchor + offset.

    A place outside the episode is null; with pad, it is the episode's first or last value.  Up to four offsets become
    lead/lag; more share one framed collect_list, from which the offsets' places are picked.
    """
    value = F.col(value) if isinstance(value, str) else value
    w = frames(episode, frame)
    if len(offsets) <= 4:
        whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        first, last = F.first(value).over(whole), F.last(value).over(whole)
        at = F.row_number().over(w) - 1
        n = F.count(F.lit(1)).over(within(episode))
        out = []
        for d in offsets:
            got = F.lead(value, d).over(w) if d >= 0 else F.lag(value, -d).over(w)
            out.append(F.when(at + d < 0, first).when(at + d >= n, last).otherwise(got) if pad else got)
        return F.array(*out)
    low, high = min(offsets), max(offsets)
    # Structs keep nulls, which collect_list drops.
    held = F.collect_list(F.struct(value.alias("v"))).over(w.rowsBetween(low, high))
    before = F.row_number().over(w) - 1
    n = F.count(F.lit(1)).over(within(episode))
    first = F.greatest(F.lit(low), -before)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    head, tail = F.first(value).over(whole), F.last(value).over(whole)
    places = F.array(*[F.lit(d) for d in offsets])
    if pad:
        return F.transform(places, lambda d: F.when(before + d < 0, head).when(before + d >= n, tail).otherwise(F.get(held, (d - first).cast("int"))["v"]))
    return F.transform(places, lambda d: F.when((before + d >= 0) & (before + d < n), F.get(held, (d - first).cast("int"))["v"]))


def chunked(df: DataFrame, value: Column | str, offsets: Sequence[int], *, name: str = "chunk", pad: bool = False, episode: str | Sequence[str] = "episode", frame: str = "frame", block: int | None = None) -> DataFrame:
    """Anchors with their chunk: all anchors if padded, else those whose every offset lies in the episode.

    An episode is one task's, unless ``block`` is given: then it is cut in blocks of that many frames with halos as wide as the
    offsets reach, so an episode may be of any length.  Frames must then be places from 0 without gaps.
    """
    if block is not None:
        keys = [episode] if isinstance(episode, str) else list(episode)
        rows = haloed(df, min(0, *offsets), max(0, *offsets), block, frame=frame)
        return chunked(rows, value, offsets, name=name, pad=pad, episode=[*keys, "block_"], frame=frame).where("own_").drop("block_", "own_")
    out = df.withColumn(name, gathered(value, offsets, pad=pad, episode=episode, frame=frame))
    if pad:
        return out
    n = F.count(F.lit(1)).over(within(episode))
    at = F.row_number().over(frames(episode, frame)) - 1
    return out.withColumn("at_", at).withColumn("n_", n).where((F.col("at_") + max(offsets) < F.col("n_")) & (F.col("at_") + min(offsets) >= 0)).drop("at_", "n_")


def contiguous(df: DataFrame, value: str, horizon: int, **names) -> DataFrame:
    return chunked(df, value, range(horizon), **names)


def required_frames(anchors: DataFrame, offsets: Sequence[int], episode: str = "episode", frame: str = "frame") -> DataFrame:
    """Distinct frames that anchors need at some offsets; none below 0."""
    need = anchors.select(episode, F.explode(F.array(*[F.col(frame) + d for d in offsets])).alias(frame))
    return need.where(F.col(frame) >= 0).distinct()


def union_offsets(*offsets: Sequence[int]) -> list[int]:
    """Offsets that any of several modalities asks for, ascending."""
    return sorted({d for own in offsets for d in own})


def replay_from(df: DataFrame, value: str, horizon: int, which: int, step: int, *, episode: str = "episode", frame: str = "frame") -> DataFrame:
    """The chunks that a replay of one episode gives from a step on; an episode or step that isn't there is an error."""
    own = df.where(F.col(episode) == which)
    out = replay_chunk(own, value, horizon, episode=episode, frame=frame).where(F.col(frame) >= step)
    if step < 0 or not out.take(1):
        raise ValueError(f"episode {which} has no step {step}")
    return out


def replay_chunk(df: DataFrame, value: str, horizon: int, **names) -> DataFrame:
    """horizon rows from each step on, the last row repeated past the end."""
    return chunked(df, value, range(horizon), pad=True, **names)


def history_offsets(offsets: Sequence[int]) -> list[int]:
    """Checks that history offsets end at 0 and step evenly, and returns them."""
    offsets = list(offsets)
    if not offsets or offsets[-1] != 0 or offsets[0] > 0:
        raise ValueError("history offsets end at 0")
    steps = {b - a for a, b in zip(offsets[:-1], offsets[1:], strict=True)}
    if len(steps) > 1 or any(s <= 0 for s in steps):
        raise ValueError("history offsets step evenly and ascend")
    return offsets


def history(df: DataFrame, value: str, offsets: Sequence[int], **names) -> DataFrame:
    """Past values up to the present, the first one standing in before the start."""
    return chunked(df, value, history_offsets(offsets), pad=True, **names)


def resampled(df: DataFrame, dt: float, *, start: float = 0.0, episode: str = "episode", time: str = "t", order: str = "frame", block: int | None = None) -> DataFrame:
    """Fixed-rate resampling: each sample is given for the grid places from the next free one to its own.

    Gaps repeat the later sample, samples that share a place with an earlier one give none, places below 0 are skipped.
    Adds grid (place) and grid_t.  With ``block``, an episode is cut in blocks of that many frames, each of which starts where
    those before have come to; ``order`` must then hold places from 0 without gaps.
    """
    place = F.floor((F.col(time) - start) / dt + 1e-5)
    out, keys, before = df.withColumn("place_", place), [episode], F.lit(-1)
    if block is not None:
        out = carried(out.withColumn("block_", block_of(order, block)), {"top_": (F.col("place_"), F.max)}, [episode])
        keys, before = [episode, "block_"], F.coalesce("top_", F.lit(-1))
    w = frames(keys, order).rowsBetween(W.unboundedPreceding, -1)
    out = out.withColumn("free_", F.greatest(F.coalesce(F.max("place_").over(w), F.lit(-1)), before, F.lit(-1)) + 1)
    out = out.where(F.col("place_") >= F.col("free_")).withColumn("grid", F.explode(F.sequence("free_", "place_")))
    return out.withColumn("grid_t", start + F.col("grid") * dt).drop("place_", "free_", "block_", "top_")


def straight(a: Column, b: Column, share: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + share * (y - x))


def interpolated(samples: DataFrame, times: DataFrame, *, episode: str = "episode", time: str = "t", value: str = "v", blend: Callable[[Column, Column, Column], Column] = straight, block: int | None = None) -> DataFrame:
    """Arrays at requested times (episode, at), blended from the samples on both sides: in a straight line by default.

    Times outside an episode's samples are errors, and so is an episode with fewer than two samples of ascending times.
    Samples whose time doesn't exceed the largest before are dropped.  Both sides meet in one sort per episode; with ``block``,
    in one of blocks of that many samples and times, each knowing the nearest samples of other blocks.
    """
    own, keys = samples.withColumn("block_", block_of("frame", block) if block else F.lit(0)), [episode, "block_"]
    top = F.max(time).over(frames(keys, "frame").rowsBetween(W.unboundedPreceding, -1))
    if block:
        own = carried(own, {"top_": (F.col(time), F.max)}, [episode])
        top = F.greatest(top, F.col("top_"))
    own = own.withColumn("so_far_", top).where(F.col("so_far_").isNull() | (F.col(time) > F.col("so_far_")))
    both = own.select(episode, F.col(time), F.struct(F.col(time).alias("t"), F.col(value).alias("v")).alias("s"), F.lit(False).alias("asked"))
    both = both.unionByName(times.select(episode, F.col("at").alias(time), F.lit(None).cast(both.schema["s"].dataType).alias("s"), F.lit(True).alias("asked")))
    both = placed(both, [time, "asked"], [episode], name="place_") if block else both.withColumn("place_", F.lit(None).cast("long"))
    both = both.withColumn("block_", block_of("place_", block) if block else F.lit(0))
    # A sample at the very time comes first, so it is the left one; then it is the right one too.
    w = within(keys).orderBy(time, "asked")
    left = F.last("s", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    # What follows is what comes before in descending order: a frame that ends with the group is evaluated anew for every row.
    right = F.last("s", ignorenulls=True).over(within(keys).orderBy(F.desc(time), F.desc("asked")).rowsBetween(W.unboundedPreceding, 0))
    if block:
        here = F.when(~F.col("asked"), F.struct(F.col(time).alias("t"), F.col("s")))
        both = carried(carried(both, {"l_": (here, F.max), "n_": (F.col("s").isNotNull().cast("long"), F.sum)}, [episode]), {"r_": (here, F.min), "m_": (F.col("s").isNotNull().cast("long"), F.sum)}, [episode], after=True)
        left, right = F.coalesce(left, F.col("l_.s")), F.coalesce(right, F.col("r_.s"))
    n = F.count("s").over(within(keys)) + (F.coalesce("n_", F.lit(0)) + F.coalesce("m_", F.lit(0)) if block else F.lit(0))
    out = both.select(episode, F.col(time).alias("at"), "asked", left.alias("l"), right.alias("r"), n.alias("count_")).where("asked")
    out = out.withColumn("r", F.when(F.col("l.t") == F.col("at"), F.col("l")).otherwise(F.col("r")))
    share = F.when(F.col("r.t") > F.col("l.t"), (F.col("at") - F.col("l.t")) / (F.col("r.t") - F.col("l.t"))).otherwise(0.0)
    mixed = F.when(F.col("count_") < 2, F.raise_error(F.lit("interpolation needs two samples"))).when(F.col("l").isNull() | F.col("r").isNull(), F.raise_error(F.lit("a time outside the samples"))).otherwise(blend(F.col("l.v"), F.col("r.v"), share))
    return out.select(episode, "at", mixed.alias(value))


def even_times(samples: DataFrame, n: int, *, episode: str = "episode", time: str = "t") -> DataFrame:
    """(episode, at): n times from an episode's first sample to its last, evenly apart, both included."""
    ends = samples.groupBy(episode).agg(F.min(time).alias("a_"), F.max(time).alias("b_"))
    step = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i_")
    at = F.when(F.col("i_") == n - 1, F.col("b_")).otherwise(F.col("a_") + F.col("i_") / (n - 1) * (F.col("b_") - F.col("a_")))
    return ends.select(episode, "a_", "b_", step).select(episode, at.alias("at"))


def counters(steps: DataFrame, done: str = "done", env: str = "env", order: str = "step") -> DataFrame:
    """Adds each environment's frame number, and the length so far of the rollout at hand."""
    w = W.partitionBy(env).orderBy(order)
    part = F.coalesce(F.sum(F.col(done).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = steps.withColumn("frame_number", F.row_number().over(w) - 1).withColumn("part_", part)
    return own.withColumn("length", F.row_number().over(W.partitionBy(env, "part_").orderBy(order))).drop("part_")


def last_n(values: Column, n: int) -> Column:
    """The last n items of an array, or all of a shorter one."""
    return F.slice(values, F.greatest(F.size(values) - n, F.lit(0)) + 1, n)


def consumed(chunks: DataFrame, horizon: int, *, chunk: str = "chunk", episode: str = "episode", frame: str = "frame") -> DataFrame:
    """What a closed loop executes that asks for a chunk every ``horizon`` steps: step k takes row k mod horizon of the
    chunk asked for last.  Adds asked (its frame) and executed."""
    at = F.row_number().over(frames(episode, frame)) - 1
    # The chunk at hand is that of the last step whose number the horizon divides.
    held = F.last(F.when(F.col("step_") % horizon == 0, F.struct(F.col(frame).alias("f"), F.col(chunk).alias("c"))), ignorenulls=True).over(frames(episode, frame).rowsBetween(W.unboundedPreceding, 0))
    out = chunks.withColumn("step_", at).withColumn("held_", held)
    return out.withColumn("asked", F.col("held_.f")).withColumn("executed", F.get(F.col("held_.c"), (F.col("step_") % horizon).cast("int"))).drop("step_", "held_")
