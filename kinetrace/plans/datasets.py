"""Queries that write datasets, read them back and stream them: what comes back must equal the events they were made of."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.operators import joins, sharding, stats
from kinetrace.operators.blocks import written as spilled
from kinetrace.sources import lerobot, shards, sinks
from kinetrace.sources.storage import shared_folder
from kinetrace.streaming import frames as streams

from .registry import query, r6
from .views import EVENTS, events

_MODALITY = {
    "state": {"both": {"start": 0, "end": 2}, "k": {"start": 1, "end": 2}},
    "action": {"value": {"start": 0, "end": 1}, "copy": {"start": 0, "end": 1, "original_key": "observation.state"}},
}
_INFO = {
    "codebase_version": "v2.1", "chunks_size": 100, "data_path": "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet", "video_path": "videos/chunk-{episode_chunk:03d}/{video_key}/episode_{episode_index:06d}.mp4",
    "features": {"observation.state": {"dtype": "float64", "shape": [2]}, "action": {"dtype": "float64", "shape": [1]}, "frame_index": {"dtype": "int64", "shape": [1]}},
    "splits": {"few": "0:20", "rest": "21:100000"},
}


def _frames(spark, sf) -> DataFrame:
    df = events(spark, sf)
    return df.select(F.array("value", F.col("k").cast("double")).alias("observation.state"), F.array("value").alias("action"), F.col("t").alias("timestamp"), F.col("frame").alias("frame_index"), F.col("episode").alias("episode_index"), (F.crc32(F.col("kind").cast("binary")) % 97).alias("task_index"), "kind")


def written(spark: SparkSession, sf: str) -> lerobot.TrajectoryDataset:
    """The events as a dataset directory in the shared folder."""
    root = f"{shared_folder(spark)}/dataset-{uuid.uuid4().hex[:12]}"
    frames = _frames(spark, sf)
    episodes = frames.groupBy("episode_index").agg(F.array_sort(F.collect_set("kind")).alias("tasks"), F.count("*").alias("length"))
    tasks = frames.select("task_index", F.col("kind").alias("task")).distinct()
    sinks.write_dataset(frames.drop("kind"), episodes, tasks, _INFO, _MODALITY, root)
    return lerobot.TrajectoryDataset(spark, root)


@query("SELECT episode, frame, round(value, 6) + 0.0 AS value, CAST(k AS DOUBLE) AS k, round(value, 6) + 0.0 AS copy, CAST(length AS BIGINT) AS length FROM ep", EVENTS)
def dataset_round_trip(spark, sf):
    df = written(spark, sf).load()
    return df.select(F.col("episode_index").alias("episode"), F.col("frame_index").alias("frame"), r6(F.col("`action.value`")[0]).alias("value"), F.col("`state.k`")[0].alias("k"), r6(F.col("`action.copy`")[0]).alias("copy"), "length")


@query("SELECT episode, frame, kind AS task FROM ep", EVENTS)
def dataset_tasks(spark, sf):
    data = written(spark, sf)
    return joins.with_task(data.frames(columns=["task_index"]), data.tasks).select(F.col("episode_index").alias("episode"), F.col("frame_index").alias("frame"), "task")


@query("SELECT DISTINCT episode, least(frame * 9, length - 1) AS frame, CAST(max(k) OVER (PARTITION BY episode, least(frame * 9, length - 1)) * 0 AS DOUBLE) AS zero FROM ep", EVENTS)
def dataset_sparse(spark, sf):
    data = written(spark, sf)
    need = data.frames(columns=[]).select("episode_index", (F.col("frame_index") * 9).alias("frame_index"))
    return data.sparse(need, clamp=True).select(F.col("episode_index").alias("episode"), F.col("frame_index").alias("frame"), (F.col("`observation.state`")[1] * 0).alias("zero"))


@query("""
a AS (SELECT episode, frame, length FROM ep WHERE episode % 7 = 3 AND frame % 5 = 2),
w AS (SELECT DISTINCT episode, greatest(least(frame + d, length - 1), 0) AS frame FROM a, (SELECT unnest([-3, 0, 8]) AS d))
----SELECT w.episode, w.frame, round(value, 6) + 0.0 AS value FROM w JOIN ep ON ep.episode = w.episode AND ep.frame = w.frame
""", EVENTS)
def dataset_shard_frames(spark, sf):
    """What the anchors of one shard see, read from the files and row groups that hold it."""
    data = written(spark, sf)
    plan = events(spark, sf).where("frame % 5 = 2").select("episode", "frame", (F.col("episode") % 7).cast("int").alias("shard"))
    out = data.shard_frames(plan, 3, [-3, 0, 8], columns=["action"])
    return out.select(F.col("episode_index").alias("episode"), F.col("frame_index").alias("frame"), r6(F.col("action")[0]).alias("value"))


@query("SELECT CAST(count(DISTINCT episode) AS BIGINT) AS total_episodes, CAST(count(*) AS BIGINT) AS total_frames, CAST(count(DISTINCT kind) AS BIGINT) AS total_tasks, CAST(ceil(count(DISTINCT episode) / 100) AS BIGINT) AS total_chunks FROM ep", EVENTS)
def dataset_totals(spark, sf):
    totals = written(spark, sf).totals()
    return spark.createDataFrame([tuple(totals[k] for k in ("total_episodes", "total_frames", "total_tasks", "total_chunks"))], "total_episodes long, total_frames long, total_tasks long, total_chunks long")


@query("SELECT DISTINCT episode, printf('data/chunk-%03d/episode_%06d.parquet', CAST(episode // 100 AS BIGINT), CAST(episode AS BIGINT)) AS path FROM ep", EVENTS)
def dataset_files(spark, sf):
    data = written(spark, sf)
    return data.files().select(F.col("episode_index").alias("episode"), F.expr(f"substr(path, {len(data.root) + 2})").alias("path"))


_SLICED = """
l AS (SELECT 'state.both' AS key, 0 AS i, value AS x FROM ep UNION ALL SELECT 'state.both', 1, CAST(k AS DOUBLE) FROM ep UNION ALL SELECT 'state.k', 0, CAST(k AS DOUBLE) FROM ep UNION ALL SELECT 'action.value', 0, value FROM ep UNION ALL SELECT 'action.copy', 0, value FROM ep)
----SELECT key, i, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(quantile_cont(x, 0.01), 6) AS q01, round(quantile_cont(x, 0.99), 6) AS q99 FROM l GROUP BY key, i
"""


@query(_SLICED, EVENTS)
def dataset_statistics(spark, sf):
    """Statistics written where they are missing, read again and cut to the declared slices."""
    data = written(spark, sf)
    assert stats.ensure_stats(data, {}, range(4)) == ["stats.json"]
    again = data.reread(need_stats=True)
    assert stats.ensure_stats(again, {}, range(4)) == []
    rows = [(f"{m}.{k}", i, *[float(own[n][i]) for n in ("mean", "std", "q01", "q99")]) for m, keys in stats.dataset_statistics(again).items() for k, own in keys.items() for i in range(len(own["mean"]))]
    df = spark.createDataFrame(rows, "key string, i int, mean double, std double, q01 double, q99 double")
    return df.select("key", "i", *[r6(c).alias(c) for c in ("mean", "std", "q01", "q99")])


@query("SELECT episode, CAST(count(*) AS BIGINT) AS length FROM ep WHERE episode IN (SELECT DISTINCT episode FROM ep ORDER BY episode LIMIT 7) GROUP BY episode", EVENTS)
def dataset_sample(spark, sf):
    """The first seven episodes, with the tasks that they refer to."""
    data = written(spark, sf)
    frames, episodes, tasks = sinks.sample_dataset(data.frames(), data.episodes, data.tasks, 7)
    joins.with_task(frames, tasks)
    return frames.groupBy(F.col("episode_index").alias("episode")).agg(F.count("*").alias("length"))


_FILES = """
i AS (SELECT episode, min(r) AS f, max(r) + 1 AS t FROM (SELECT episode, row_number() OVER (ORDER BY episode, frame) - 1 AS r FROM ep) GROUP BY episode),
c AS (SELECT *, CAST(episode // 40 AS BIGINT) AS chunk, CAST(episode // 10 % 4 AS BIGINT) AS file FROM i)
----"""


def _consolidated(spark, sf) -> DataFrame:
    sizes = events(spark, sf).groupBy("episode").agg(F.count("*").alias("n"))
    from pyspark.sql.window import Window as W

    to = F.sum("n").over(W.orderBy("episode"))
    return sizes.select(F.col("episode").alias("episode_index"), (to - F.col("n")).alias("dataset_from_index"), to.alias("dataset_to_index"), F.floor(F.col("episode") / 40).alias("data/chunk_index"), (F.floor(F.col("episode") / 10) % 4).alias("data/file_index"), (F.col("n") * 0.5).alias("videos/cam/to_timestamp"), F.lit(0.0).alias("videos/cam/from_timestamp"), F.col("n").cast("double").alias("stats/action/mean"))


@query(_FILES + "SELECT chunk, file, array_to_string(list(episode ORDER BY episode), ',') AS episodes FROM c GROUP BY chunk, file", EVENTS)
def episodes_by_file(spark, sf):
    out = lerobot.episodes_by_file(_consolidated(spark, sf))
    return out.select("chunk", "file", F.concat_ws(",", F.transform("episodes", lambda e: e.cast("string"))).alias("episodes"))


@query(_FILES + "SELECT episode AS episode_index, CAST(f AS BIGINT) AS dataset_from_index, CAST(t AS BIGINT) AS dataset_to_index, CAST(t - f AS BIGINT) AS length FROM c", EVENTS)
def legacy_episode_lines(spark, sf):
    return sinks.legacy_episodes(_consolidated(spark, sf)).select("episode_index", F.col("dataset_from_index").cast("long").alias("dataset_from_index"), F.col("dataset_to_index").cast("long").alias("dataset_to_index"), F.col("length").cast("long").alias("length"))


@query(_FILES + "SELECT episode AS episode_index, 'action' AS feature, 'mean' AS stat, '[' || CAST(CAST(t - f AS DOUBLE) AS VARCHAR) || ']' AS value FROM c", EVENTS)
def episode_stat_lines(spark, sf):
    return sinks.episode_stats(_consolidated(spark, sf))


@query(_FILES + "SELECT episode AS episode_index, 0.0::DOUBLE AS from_s, (t - f) * 0.5::DOUBLE AS to_s FROM c", EVENTS)
def segment_plan(spark, sf):
    return sinks.segment_plan(_consolidated(spark, sf), "cam")


@query("SELECT 'a' AS dataset, episode, frame FROM ep WHERE episode % 2 = 0 UNION ALL SELECT 'b', episode, frame FROM ep WHERE episode % 3 = 0", EVENTS)
def dataset_union(spark, sf):
    df = events(spark, sf)
    return lerobot.union_of({"a": df.where("episode % 2 = 0").select("episode", "frame", "k"), "b": df.where("episode % 3 = 0").select("episode", "frame")}).select("dataset", "episode", "frame")


@query("SELECT episode, frame, CAST(frame * 2 AS BIGINT) AS image FROM ep", EVENTS)
def frames_with_media(spark, sf):
    df = events(spark, sf).select("episode", "frame")
    return joins.with_media(df, df.withColumn("image", (F.col("frame") * 2).cast("long")), ["image"])


@query("SELECT episode AS trajectory, 'value' AS key, CAST(frame AS INTEGER) AS i, round(value, 6) + 0.0 AS x FROM ep WHERE frame < 3", EVENTS)
def initial_actions(spark, sf):
    """The first actions of each episode, kept as a table beside the metadata."""
    data = written(spark, sf)
    assert data.initial_actions() is None
    first = data.load(columns=[]).where("frame_index < 3").groupBy(F.col("episode_index").alias("trajectory")).agg(F.array_sort(F.collect_list(F.struct("frame_index", F.col("`action.value`").alias("row")))).alias("rows"))
    first.select("trajectory", F.lit("value").alias("key"), F.transform("rows", lambda r: r["row"]).alias("action")).write.parquet(f"{data.root}/meta/initial_actions")
    return data.initial_actions().select("trajectory", "key", F.posexplode("action").alias("i", "row")).select("trajectory", "key", "i", r6(F.col("row")[0]).alias("x"))


# -- shards ----------------------------------------------------------------------------------------------------------


@query("SELECT CAST(episode % 7 AS INTEGER) AS shard, episode, frame FROM ep WHERE episode % 7 IN (1, 4)", EVENTS)
def shard_source(spark, sf):
    """Shards written as folders and read by the data source, two of them."""
    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex[:12]}"
    df = events(spark, sf).select((F.col("episode") % 7).cast("int").alias("shard"), "episode", "frame")
    sharding.write_shards(df, path, shards=7)
    shards.register(spark)
    return spark.read.format("trajectory_shards").schema("shard int, episode long, frame long").option("path", path).option("shards", "1,4").load()


@query("""
s AS (SELECT *, lead(k, 2) OVER w AS k2, lag(value, 1) OVER w AS v1 FROM ep WINDOW w AS (PARTITION BY episode ORDER BY frame))
----SELECT CAST(episode % 7 AS INTEGER) AS shard, episode, frame, concat_ws(',', CAST(k AS VARCHAR), CAST(k2 AS VARCHAR)) AS actions, round(coalesce(v1, 0), 6) + 0.0 AS before FROM s WHERE frame + 2 < length AND episode % 7 = 3
""", EVENTS)
def shard_samples(spark, sf):
    """The samples of one shard: a history of two states and two later actions at each anchor."""
    df = events(spark, sf)
    frames = df.select("episode", "frame", F.array("value").alias("state.v"), F.array(F.col("k").cast("double")).alias("action.k"))
    plan = df.where(F.col("frame") + 2 < F.col("length")).select("episode", "frame", (F.col("episode") % 7).cast("int").alias("shard"))
    out = sharding.shard_samples(plan, frames, 3, ["v"], ["k"], [-1, 0], [0, 2])
    rows = F.concat_ws(",", F.transform(F.col("actions")["k"], lambda r: r[0].cast("int").cast("string")))
    return out.select("shard", "episode", "frame", rows.alias("actions"), r6(F.coalesce(F.col("states")["v"][0][0], F.lit(0.0))).alias("before"))


# -- streams ---------------------------------------------------------------------------------------------------------


#: Rows that a file of a stream holds at least, once there are as many.
FILE_ROWS = 1_000_000


def _stream(spark, df: DataFrame, slices: int, time: str = "ts") -> DataFrame:
    """A stream over files of df, in order of time, one of as many slices of time a micro-batch.

    Every slice is dealt out over the same number of files, so that a trigger takes one slice.  A file has more rows than there
    are files, so none stays empty."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"
    df, at = spilled(df, "streamed"), F.unix_micros(time)
    low, high = df.agg(F.min(at), F.max(at)).first()
    part = F.floor((at - low) * slices / (high - low + 1))
    counts = {r.part: r["count"] for r in df.groupBy(part.alias("part")).count().collect()}
    files = max(1, min(counts.get(i, 0) for i in range(slices)) // FILE_ROWS)
    for i in range(slices):
        df.where(part == i).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _stamped(spark, sf) -> DataFrame:
    """The episodes' events with their time, ts."""
    return events(spark, sf, F.col("ts").cast("timestamp").alias("ts"))


_STAMPED = """
st AS (SELECT user_id AS episode, event_id, ts, row_number() OVER w - 1 AS frame, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query("""
g AS (SELECT ep.*, gap, CAST(floor(t / 7200 + 1e-5) AS BIGINT) AS gi FROM ep JOIN st ON st.episode = ep.episode AND st.frame = ep.frame),
n AS (SELECT *, CASE WHEN gap > 86400000000 THEN gi ELSE greatest(coalesce(max(gi) OVER (PARTITION BY episode ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), -1) + 1 END AS free FROM g)
----SELECT episode, frame, unnest(generate_series(free, gi)) AS grid FROM n WHERE gi >= free
""", EVENTS, _STAMPED)
def resample_stream(spark, sf):
    """Silences of more than a day are not filled, and end an episode's state."""
    stream = _stream(spark, _stamped(spark, sf).select("episode", "frame", "t", "ts"), 3)
    return streams.drained(streams.resample_stream(stream, 7200.0, late="1 hour", idle="1 day"), f"resampled_{uuid.uuid4().hex[:8]}").select("episode", "frame", "grid")


@query("""
s AS (SELECT ep.episode AS env, ep.frame, ts, value, kind = 'purchase' AS success, done, coalesce(gap > 86400000000, false) AS silent FROM ep JOIN st ON st.episode = ep.episode AND st.frame = ep.frame),
e AS (SELECT *, sum(CAST(silent AS INTEGER)) OVER w AS era, coalesce(lag(done) OVER w, true) OR silent AS fresh FROM s WINDOW w AS (PARTITION BY env ORDER BY frame)),
p AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY env ORDER BY frame) AS part FROM e),
r AS (SELECT env, era, part, count(*) AS length, sum(value) AS reward, bool_or(success) AS success, NOT bool_or(done) AS cut, max(ts) AS last FROM p GROUP BY ALL),
l AS (SELECT *, row_number() OVER (PARTITION BY env, era ORDER BY part) - 1 AS rollout, lead(env) OVER (PARTITION BY env ORDER BY part) AS more FROM r)
----SELECT env, CAST(rollout AS BIGINT) AS rollout, CAST(length AS BIGINT) AS length, round(reward, 4) AS reward, success, cut FROM l WHERE NOT cut OR more IS NOT NULL OR epoch_us(last) + 86400001000 < (SELECT max(epoch_us(ts)) - 3600000000 FROM events)
""", EVENTS, _STAMPED)
def rollout_stream(spark, sf):
    """A day of silence cuts a rollout."""
    steps = _stamped(spark, sf).select(F.col("episode").alias("env"), F.col("frame").alias("step"), F.col("value").alias("reward"), (F.col("kind") == "purchase").alias("success"), "done", "ts")
    out = streams.drained(streams.rollout_stream(_stream(spark, steps, 3), late="1 hour", idle="1 day"), f"rollouts_{uuid.uuid4().hex[:8]}")
    return out.withColumn("reward", F.round("reward", 4))


_SEGMENTS = """
b AS (SELECT user_id AS device, event_id AS row, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
sg AS (SELECT *, last_value(CASE WHEN gap IS NULL OR gap > 43200000000 THEN epoch_us(ts) END IGNORE NULLS) OVER (PARTITION BY device ORDER BY ts, row ROWS UNBOUNDED PRECEDING) AS start FROM b)"""


def _raw(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("device"), F.col("event_id").alias("row"), F.col("ts").cast("timestamp").alias("ts"))


_NUMBERED = "SELECT device, row, start, row_number() OVER (PARTITION BY device, start ORDER BY ts, row) - 1 AS frame FROM sg"


@query(_NUMBERED, _SEGMENTS)
def segmented_frames(spark, sf):
    """Events of a user cut into episodes by half a day of silence."""
    return streams.segmented(_raw(spark, sf), "12 hours", order=["row"]).select("device", "row", F.unix_micros("start").alias("start"), "frame")


@query(_NUMBERED, _SEGMENTS)
def segment_stream(spark, sf):
    """The same, numbered as they come."""
    out = streams.drained(streams.segment_stream(_stream(spark, _raw(spark, sf), 3), "12 hours", late="1 hour"), f"segments_{uuid.uuid4().hex[:8]}")
    return out.select("device", "row", F.unix_micros("start").alias("start"), "frame")


@query('SELECT device, start, max(epoch_us(ts)) AS "end", CAST(count(*) AS BIGINT) AS length FROM sg GROUP BY device, start', _SEGMENTS)
def episode_windows(spark, sf):
    out = streams.episode_windows(_raw(spark, sf), "12 hours")
    return out.select("device", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "length")
