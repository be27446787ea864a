"""Stateful forms of resampling and rollout tracking over streams of frames."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinetrace.sources.storage import shared_folder

_RESAMPLED = "episode long, frame long, t double, grid long, grid_t double"


def grid_places(t: np.ndarray, dt: float, start: float, free: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sample and grid place of each emitted row, and the next free place after them."""
    place = np.floor((t - start) / dt + 1e-5).astype(np.int64)
    after = np.maximum(np.maximum.accumulate(place) + 1, free) if len(place) else place
    first = np.concatenate(([free], after[:-1])) if len(place) else place
    count = np.maximum(place + 1 - first, 0)
    sample = np.repeat(np.arange(len(place)), count)
    grid = first[sample] + np.arange(len(sample)) - np.repeat(np.cumsum(count) - count, count)
    return sample, grid, int(after[-1]) if len(place) else free


def _micros(interval: str) -> int:
    """Of an interval such as `10 minutes`."""
    return pd.Timedelta(interval).value // 1000


def _in_order(batches, *by: str) -> dict[str, np.ndarray]:
    """A group's rows by some columns, as arrays: groups are small and many, and frames cost milliseconds a group."""
    parts = list(batches)
    rows = parts[0] if len(parts) == 1 else pd.concat(parts)
    order = np.lexsort([rows[c].to_numpy() for c in reversed(by)])
    return {c: rows[c].to_numpy()[order] for c in rows.columns}


def _silences(rows: dict[str, np.ndarray], time: str, last: int | None, idle: int) -> tuple[np.ndarray, np.ndarray]:
    """Times of rows (microseconds), and whether each comes more than ``idle`` after the latest before it."""
    at = rows[time].astype("datetime64[us]").astype(np.int64)
    before = np.concatenate(([at[0] if last is None else last], at))
    return at, at - np.maximum.accumulate(before)[:-1] > idle


def _kept_until(state, values: tuple, at: np.ndarray, last: int | None, idle: int) -> None:
    """Updates a group's state, which goes once the watermark is more than ``idle`` past its latest row."""
    latest = int(at.max()) if last is None else max(int(at.max()), last)
    state.update((*values, latest))
    state.setTimeoutTimestamp(max(latest // 1000, state.getCurrentWatermarkMs()) + idle // 1000 + 2)


def resample_stream(frames: DataFrame, dt: float, start: float = 0.0, *, time: str = "ts", late: str = "10 minutes", idle: str = "1 hour") -> DataFrame:
    """Fixed-rate resampling of a stream of (episode, frame, t, event time); an episode's state is its next free grid place.

    Frames of an episode must arrive in order across micro-batches; within one they are sorted.  A frame later than the
    watermark (``late`` behind the latest event time) is dropped.  An episode that is silent for more than ``idle`` has ended:
    its state goes, and if it goes on later, places in between are not filled, just as those before a first frame that comes
    more than ``idle`` after the start.
    """
    quiet = _micros(idle)

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = _in_order(batches, "frame")
        t = rows["t"].astype(float)
        free, last = state.get if state.exists else (0, None)
        at, silent = _silences(rows, time, last, quiet)
        if last is None:
            silent[0] = (t[0] - start) * 1e6 > quiet
        out = []
        for part in np.split(np.arange(len(t)), np.flatnonzero(silent)):
            if len(part):
                if silent[part[0]]:
                    free = max(free, int(np.floor((t[part[0]] - start) / dt + 1e-5)))
                sample, grid, free = grid_places(t[part], dt, start, free)
                out.append((part[sample], grid))
        sample, grid = (np.concatenate(x) for x in zip(*out, strict=True))
        _kept_until(state, (free,), at, last, quiet)
        yield pd.DataFrame({"episode": np.full(len(grid), key[0]), "frame": rows["frame"][sample], "t": t[sample], "grid": grid, "grid_t": start + grid * dt})

    return frames.withWatermark(time, late).groupBy("episode").applyInPandasWithState(run, _RESAMPLED, "free long, last long", "append", "EventTimeTimeout")


def rollout_stream(steps: DataFrame, *, time: str = "ts", late: str = "10 minutes", idle: str = "1 hour") -> DataFrame:
    """Ended rollouts of a stream of (env, step, reward, success, done, event time): length, reward sum, success ever, cut.

    A rollout ends with a done step, or is cut where its env is silent for more than ``idle``, once the watermark has passed
    that or a later step tells.  Steps later than the watermark are dropped; an env's state goes with its silence, and rollouts
    are then counted from 0 again.
    """
    quiet = _micros(idle)

    def rows_of(env, number, length, reward, success, cut):
        return pd.DataFrame({"env": np.full(len(length), env), "rollout": number, "length": length, "reward": np.asarray(reward, float), "success": success, "cut": cut})

    def run(key, batches, state):
        length, reward, success, n, last = state.get if state.exists else (0, 0.0, False, 0, None)
        if state.hasTimedOut:
            state.remove()
            if length:
                yield rows_of(key[0], np.array([n]), np.array([length]), [reward], np.array([success]), np.array([True]))
            return
        rows = _in_order(batches, "step")
        at, silent = _silences(rows, time, last, quiet)
        done = rows["done"].astype(bool)
        ended = np.concatenate(([length == 0], done[:-1]))
        # A part begins after a done step or a silence; what earlier batches left open is part 0.
        fresh = silent & ~ended
        part = np.cumsum(np.concatenate(([False], done[:-1])) | fresh)
        # After a silence an env counts from 0, whether its state has gone already or not.
        era = np.cumsum(silent)
        parts = int(part[-1]) + 1
        lengths = np.bincount(part, minlength=parts)
        rewards = np.bincount(part, rows["reward"].astype(float), parts)
        wins = np.bincount(part, rows["success"].astype(bool), parts) > 0
        lengths[0], rewards[0], wins[0] = lengths[0] + length, rewards[0] + reward, bool(wins[0] or success)
        over = np.zeros(parts, bool)
        over[part[done]] = True
        closed = parts if done[-1] else parts - 1
        # The era of a part is that of its first row; of part 0 without rows here, the one before.
        eras = np.full(parts, 0 if part[0] else era[0])
        eras[part[::-1]] = era[::-1]
        if length and silent[0]:
            eras[0] = 0
        number = np.empty(parts, np.int64)
        count, now = n, 0
        for i in range(parts):
            if eras[i] != now:
                count, now = 0, eras[i]
            number[i] = count
            count += 1
        if closed < parts:
            left = (int(lengths[-1]), float(rewards[-1]), bool(wins[-1]), int(number[-1]))
        else:
            left = (0, 0.0, False, int(number[-1]) + 1)
        _kept_until(state, left, at, last, quiet)
        if closed:
            yield rows_of(key[0], number[:closed], lengths[:closed], rewards[:closed], wins[:closed], ~over[:closed])

    schema, kept = "env long, rollout long, length long, reward double, success boolean, cut boolean", "length long, reward double, success boolean, n long, last long"
    return steps.withWatermark(time, late).groupBy("env").applyInPandasWithState(run, schema, kept, "append", "EventTimeTimeout")


def segmented(frames: DataFrame, gap: str, *, key: str = "device", time: str = "ts", order: Sequence[str] = ()) -> DataFrame:
    """A raw table cut into episodes: adds start (the episode's first time) and frame.  A row more than ``gap`` after the one
    before it begins a new episode.  Rows are ordered by time, then by ``order``."""
    w = W.partitionBy(key).orderBy(time, *order)
    since = F.unix_micros(F.col(time)) - F.unix_micros(F.lag(time).over(w))
    begins = F.when(since.isNull() | (since > _micros(gap)), F.col(time))
    out = frames.withColumn("start", F.last(begins, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return out.withColumn("frame", (F.row_number().over(W.partitionBy(key, "start").orderBy(time, *order)) - 1).cast("long"))


def episode_windows(frames: DataFrame, gap: str, *, key: str = "device", time: str = "ts", late: str | None = None) -> DataFrame:
    """key, start, end, length of the episodes of ``segmented``, by session windows; of a stream, each once it can't grow on."""
    own = frames if late is None else frames.withWatermark(time, late)
    made = own.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("length"), F.max(time).alias("end"))
    return made.select(key, F.col("w.start").alias("start"), "end", "length")


def segment_stream(frames: DataFrame, gap: str, *, key: str = "device", time: str = "ts", row: str = "row", late: str = "10 minutes") -> DataFrame:
    """(key, row, start, frame) of a stream, as ``segmented`` gives them: frames are numbered as they come, a device's state is
    its episode's start and length, and goes ``gap`` after its last row.  Rows later than the watermark are dropped; rows of a
    device must arrive in order across micro-batches, and are sorted by time and row within one."""
    quiet = _micros(gap)

    def run(k, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = _in_order(batches, time, row)
        start, n, last = state.get if state.exists else (None, 0, None)
        at, silent = _silences(rows, time, last, quiet)
        begins = silent.copy()
        begins[0] |= start is None
        which = np.cumsum(begins)
        first = np.flatnonzero(begins)
        starts = np.concatenate(([start or 0], at[first]))
        base = np.concatenate(([-n], first))
        frame = np.arange(len(at)) - base[which]
        _kept_until(state, (int(starts[which[-1]]), int(frame[-1]) + 1), at, last, quiet)
        yield pd.DataFrame({key: np.full(len(at), k[0]), row: rows[row], "start": starts[which].astype("datetime64[us]").astype("datetime64[ns]"), "frame": frame})

    return frames.withWatermark(time, late).groupBy(key).applyInPandasWithState(run, f"{key} long, {row} long, start timestamp, frame long", "start long, n long, last long", "append", "EventTimeTimeout")


def windowed_counts(frames: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Frames per window with a watermark: late frames within it still count."""
    return frames.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("frames"))


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream gives now, as files in the shared folder that executors write and read: for bounded sources, not for
    endless ones."""
    path = f"{shared_folder(stream.sparkSession)}/{name}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
