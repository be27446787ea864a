"""Joins of frames with their episodes, tasks, sub-tasks and neighbours in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinetrace.functions.language import picked


def task_index(column: Column, is_array: bool) -> Column:
    """A task index, or an array of exactly one."""
    return F.when(F.size(column) == 1, column[0]).otherwise(F.raise_error(F.lit("a task index array of another length than 1"))) if is_array else column


def with_task(frames: DataFrame, tasks: DataFrame, key: str = "task_index", text: str = "task") -> DataFrame:
    """Adds the task's text; an index without one is an error.  The dictionary is small; Spark broadcasts it by size."""
    known = tasks.select(F.col(key).alias("key_"), F.col(text).alias("text_"), F.lit(True).alias("found_"))
    out = frames.join(known, F.col(key) == F.col("key_"), "left")
    checked = F.when(F.col("found_").isNull() & F.col(key).isNotNull(), F.raise_error(F.concat(F.lit("no task "), F.col(key).cast("string")))).otherwise(F.col("text_"))
    return out.withColumn(text, checked).drop("key_", "text_", "found_")


def with_sub_task(frames: DataFrame, horizon: int, *, sub_tasks: str = "sub_tasks", episode: str = "episode", frame: str = "frame", seed: int = 0) -> DataFrame:
    """sub_task: text of an interval [start - horizon // 2, end) over the frame, one of several by hash, none: empty.

    sub_tasks is the episode's array of (start, end, text), which came with the episode join, so nothing is shuffled.
    """
    over = F.filter(sub_tasks, lambda s: (F.col(frame) >= F.greatest(s["start"] - horizon // 2, F.lit(0))) & (F.col(frame) < s["end"]))
    return frames.withColumn("sub_task", F.coalesce(picked(F.transform(over, lambda s: s["text"]), F.col(episode), F.col(frame), seed=seed), F.lit("")))


def interval_join(frames: DataFrame, intervals: DataFrame, horizon: int, *, episode: str = "episode", frame: str = "frame") -> DataFrame:
    """One row for each frame and interval (episode, start, end, text) over it: an equi-join on the episode with a range."""
    own = intervals.select(F.col(episode).alias("e_"), F.greatest(F.col("start") - horizon // 2, F.lit(0)).alias("from_"), F.col("end").alias("to_"), "text")
    return frames.join(own, (F.col(episode) == F.col("e_")) & (F.col(frame) >= F.col("from_")) & (F.col(frame) < F.col("to_"))).drop("e_", "from_", "to_")


def nearest_frames(frames: DataFrame, asked: DataFrame, *, episode: str = "episode", time: str = "t", frame: str = "frame") -> DataFrame:
    """For each asked (episode, at): the frame next to it in time, the earlier of two.  Two sorts, no range join."""
    held = frames.select(episode, F.col(time).alias("time_"), F.struct(F.col(time).alias("t"), F.col(frame).alias("f")).alias("s"), F.lit(False).alias("asked_"))
    both = held.unionByName(asked.select(episode, F.col("at").alias("time_"), F.lit(None).cast(held.schema["s"].dataType).alias("s"), F.lit(True).alias("asked_")))
    # Of samples at one time, the last frame counts before it and the first one after; both are running values of a sort, as a
    # frame that ends with the group is evaluated anew for every row.
    w = W.partitionBy(episode)
    before = F.last("s", ignorenulls=True).over(w.orderBy("time_", "asked_", "s.f").rowsBetween(W.unboundedPreceding, 0))
    after = F.last("s", ignorenulls=True).over(w.orderBy(F.desc("time_"), "asked_", F.desc("s.f")).rowsBetween(W.unboundedPreceding, 0))
    out = both.select(episode, F.col("time_").alias("at"), "asked_", before.alias("b"), after.alias("a")).where("asked_")
    pick = F.when(F.col("a").isNull() | (F.col("b").isNotNull() & (F.col("at") - F.col("b.t") <= F.col("a.t") - F.col("at"))), F.col("b")).otherwise(F.col("a"))
    return out.select(episode, "at", pick["f"].alias(frame), F.abs(pick["t"] - F.col("at")).alias("away"))


def snapped_frame(time: Column, fps: float, tolerance: float = 0.01) -> Column:
    """Frame number of a time; a miss of more than ``tolerance`` intervals is an error."""
    n = F.round(time * fps)
    return F.when(F.abs(time * fps - n) <= tolerance, n.cast("long")).otherwise(F.raise_error(F.lit("a time between frames")))


def gather_frames(frames: DataFrame, needed: DataFrame, episode: str = "episode", frame: str = "frame") -> DataFrame:
    """Only needed frames; a needed one that doesn't exist is an error."""
    want = needed.select(F.col(episode).alias("e_"), F.col(frame).alias("f_")).distinct()
    out = want.join(frames.withColumn("found_", F.lit(True)), (F.col("e_") == F.col(episode)) & (F.col("f_") == F.col(frame)), "left")
    return out.withColumn(frame, F.when(F.col("found_").isNull(), F.raise_error(F.lit("a needed frame is missing"))).otherwise(F.col(frame))).drop("e_", "f_", "found_")


def sliced_episodes(table: DataFrame, bounds: DataFrame, index: str = "index", width: int = 8192) -> DataFrame:
    """Rows of a consolidated table with the episode whose [from, to) holds their index; empty episodes are errors.

    An episode is listed in every stretch of ``width`` rows that it touches, so that rows and episodes meet by an
    equi-join on the stretch; the range is checked within it.
    """
    if bounds.where("`to` <= `from`").take(1):
        raise ValueError("an episode of length 0 or less")
    touched = bounds.withColumn("stretch_", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor((F.col("to") - 1) / width))))
    rows = table.withColumn("stretch_", F.floor(F.col(index) / width))
    met = rows.join(touched, (rows["stretch_"] == touched["stretch_"]) & (F.col(index) >= F.col("from")) & (F.col(index) < F.col("to")))
    return met.drop("stretch_").withColumn("frame", F.col(index) - F.col("from"))


def with_media(frames: DataFrame, media: DataFrame, columns: list[str], episode: str = "episode", frame: str = "frame") -> DataFrame:
    """Frames beside the images or masks of theirs (episode, frame, columns); an episode whose counts differ is an error."""
    have = frames.groupBy(F.col(episode).alias("e_")).agg(F.count("*").alias("n_"))
    given = media.groupBy(F.col(episode).alias("m_")).agg(F.count("*").alias("k_"))
    sizes = have.join(given, F.col("e_") == F.col("m_"), "left").select("e_", F.when(F.col("n_") == F.col("k_"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("frames and images differ in number in episode "), F.col("e_").cast("string")))).alias("ok_"))
    own = media.select(F.col(episode).alias("x_"), F.col(frame).alias("y_"), *columns)
    out = frames.join(sizes, F.col(episode) == F.col("e_")).where("ok_")
    return out.join(own, (F.col(episode) == F.col("x_")) & (F.col(frame) == F.col("y_")), "left").drop("e_", "ok_", "x_", "y_")
