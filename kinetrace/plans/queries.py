"""Driver queries of the trajectory operators, each with its DuckDB equivalent where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinetrace.functions import language as L
from kinetrace.functions import normalize as N
from kinetrace.functions import poses as P
from kinetrace.functions import rotations as R
from kinetrace.operators import actions as A
from kinetrace.operators import filters, geometry, joins, merge, metrics, sharding, stats, vectors, windows
from kinetrace.schema import Layout
from kinetrace.sources import schedules
from kinetrace.sources.storage import shared_folder

from .registry import ORACLES, QUERIES, each, nums, query, r6
from .views import EMBEDDINGS, EVENTS, ORDERS, embeddings, events, orders

__all__ = ["ORACLES", "QUERIES"]

# -- frames and episodes ---------------------------------------------------------------------------------------------


@query("SELECT episode, frame, length, round(t, 6) AS t FROM ep", EVENTS)
def frame_index(spark, sf):
    return events(spark, sf).select("episode", "frame", "length", r6("t").alias("t"))


@query("SELECT episode, CAST(count(*) AS BIGINT) AS length, round(max(t), 6) AS seconds FROM ep GROUP BY episode", EVENTS)
def episode_lengths(spark, sf):
    return events(spark, sf).groupBy("episode").agg(F.count("*").alias("length"), r6(F.max("t")).alias("seconds"))


@query("""
n AS (SELECT episode, dense_rank() OVER (ORDER BY episode) - 1 AS new_episode, frame FROM ep)
----SELECT episode, frame, CAST(new_episode AS INTEGER) AS new_episode, row_number() OVER (ORDER BY new_episode, frame) - 1 AS new_index FROM n
""", EVENTS)
def reindex_frames(spark, sf):
    out = vectors.reindexed(events(spark, sf).where(F.col("frame") >= 0))
    return out.select("episode", "frame", F.col("new_episode").cast("int").alias("new_episode"), F.col("new_index").cast("long").alias("new_index"))


@query("""
SELECT vec_id, 'xyz' AS key, CAST(i AS INTEGER) AS i, round(v[i + 1], 6) + 0.0 AS x FROM em, range(0, 3) r(i)
UNION ALL SELECT vec_id, 'quat', CAST(i AS INTEGER), round(v[i + 4], 6) + 0.0 FROM em, range(0, 4) r(i)
UNION ALL SELECT vec_id, 'rot6d', CAST(i AS INTEGER), round(v[i + 8], 6) + 0.0 FROM em, range(0, 6) r(i)
""", EMBEDDINGS)
def vector_slice(spark, sf):
    keys = {"xyz": (0, 3), "quat": (3, 7), "rot6d": (7, 13)}
    rows = F.array(*[F.struct(F.lit(k).alias("key"), vectors.sliced(F.col("v"), a, b).alias("x")) for k, (a, b) in keys.items()])
    return each(embeddings(spark, sf).select("vec_id", F.explode(rows).alias("r")).select("vec_id", "r.key", "r.x"), ["vec_id", "key"], "x")


@query("SELECT vec_id, CAST(i AS INTEGER) AS i, round((v[62:64] || [CAST(frame AS DOUBLE)] || v[1:2])[i + 1], 6) + 0.0 AS x FROM em, range(0, 6) r(i)", EMBEDDINGS)
def vector_concat(spark, sf):
    df = embeddings(spark, sf)
    return each(df, ["vec_id"], vectors.joined([vectors.sliced(F.col("v"), 61, 64), F.array(F.col("frame").cast("double")), vectors.sliced(F.col("v"), 0, 2)]))


@query("""
SELECT vec_id, CAST(t AS INTEGER) AS t, CAST(i AS INTEGER) AS i, CASE WHEN i < 3 AND t < 2 THEN round(v[t * 3 + i + 1], 6) + 0.0 ELSE 0.0 END AS x,
  CASE WHEN i < 3 AND t < 2 THEN 1.0::DOUBLE ELSE 0.0 END AS mask
FROM em, range(0, 4) a(t), range(0, 5) b(i)
""", EMBEDDINGS)
def pad_and_mask(spark, sf):
    chunk = F.array(vectors.sliced(F.col("v"), 0, 3), vectors.sliced(F.col("v"), 3, 6))
    rows = F.arrays_zip(vectors.padded_chunk(chunk, 5, 4).alias("x"), vectors.chunk_mask(F.lit(2), 3, 4, 5).alias("m"))
    df = embeddings(spark, sf).select("vec_id", F.posexplode(rows).alias("t", "r"))
    df = df.select("vec_id", "t", F.posexplode(F.arrays_zip(F.col("r.x").alias("x"), F.col("r.m").alias("m"))).alias("i", "z"))
    return df.select("vec_id", "t", "i", r6("z.x").alias("x"), F.col("z.m").alias("mask"))


# -- filters ---------------------------------------------------------------------------------------------------------


@query("SELECT episode, frame FROM ep WHERE frame + 15 < length", EVENTS)
def effective_anchors(spark, sf):
    return filters.effective_anchors(events(spark, sf), range(16)).select("episode", "frame")


@query("""
f AS (SELECT *, min(CASE WHEN done THEN frame END) OVER (PARTITION BY episode) AS first FROM ep)
----SELECT episode, frame FROM f WHERE frame < least(greatest(0, length - 3), coalesce(greatest(0, first - 3), length))
""", EVENTS)
def terminal_filter(spark, sf):
    return filters.terminal_filter(events(spark, sf), range(4)).select("episode", "frame")


@query("""
c AS (SELECT *, [lead(linked, 0) OVER w, lead(linked, 2) OVER w, lead(linked, 4) OVER w] AS ls, [lead(engaged, 0) OVER w, lead(engaged, 2) OVER w, lead(engaged, 4) OVER w] AS es
  FROM ep WINDOW w AS (PARTITION BY episode ORDER BY frame))
----SELECT episode, frame FROM c WHERE frame + 4 < length AND len(list_distinct(ls)) = 1 AND list_contains(es, true)
""", EVENTS)
def clutch_filter(spark, sf):
    return filters.clutch_filter(events(spark, sf), [0, 2, 4], links=["linked"], engaged=["engaged"]).select("episode", "frame")


@query("""
i AS (SELECT unnest(generate_series(0, 20)) AS episode UNION SELECT unnest(generate_series(30, 45)) UNION SELECT 77),
x AS (SELECT unnest(generate_series(10, 12)) AS episode)
----SELECT episode FROM ((SELECT episode FROM i EXCEPT SELECT episode FROM x) INTERSECT SELECT user_id FROM events)
""")
def split_resolve(spark, sf):
    splits = {"Train": "0:20, 30-45", "one": "77", "Bad": "10:12"}
    return filters.resolve_splits(spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("episode")), splits, ["train", "ONE"], ["bad", "unknown"])


@query("""
SELECT 'k' AS "column", 'size' AS problem, CAST(count(*) AS BIGINT) AS rows FROM ep WHERE len(string_split(kind, 'e')) <> 2
""", EVENTS)
def contract_report(spark, sf):
    df = events(spark, sf).select(F.split("kind", "e").alias("k"), "value")
    return filters.contract_report(df, {"k": ("array<string>", 2), "value": ("double", None)})


# -- joins -----------------------------------------------------------------------------------------------------------


@query("""
t AS (SELECT kind, dense_rank() OVER (ORDER BY kind) - 1 AS task_index FROM (SELECT DISTINCT kind FROM ep))
----SELECT episode, frame, CAST(task_index AS INTEGER) AS task_index, 'do ' || kind AS task FROM ep JOIN t USING (kind)
""", EVENTS)
def task_lookup(spark, sf):
    df = events(spark, sf)
    tasks = df.select("kind").distinct().withColumn("task_index", (F.dense_rank().over(W.orderBy("kind")) - 1).cast("int"))
    frames = df.join(tasks, "kind").select("episode", "frame", "task_index")
    return joins.with_task(frames, tasks.select("task_index", F.concat(F.lit("do "), "kind").alias("task")))


_SPANS = [(0, 10, "reach"), (8, 25, "grasp"), (40, 60, "place")]


@query("""
s(start, "end", text) AS (VALUES (0, 10, 'reach'), (8, 25, 'grasp'), (40, 60, 'place'))
----SELECT episode, frame, text FROM ep JOIN s ON frame >= greatest(start - 4, 0) AND frame < "end"
""", EVENTS)
def subtask_interval(spark, sf):
    df = events(spark, sf)
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("text")) for a, b, t in _SPANS])
    own = df.select("episode").distinct().select("episode", F.inline(spans))
    return joins.interval_join(df.select("episode", "frame"), own, 8)


@query("""
s(start, "end", text) AS (VALUES (0, 10, 'reach'), (8, 25, 'grasp'), (40, 60, 'place')),
o AS (SELECT episode, frame, list(text ORDER BY start) FILTER (WHERE frame >= greatest(start - 4, 0) AND frame < "end") AS texts FROM ep, s GROUP BY episode, frame)
----SELECT episode, frame, coalesce(texts[CAST(('0x' || substr(md5('0:' || episode || ':' || frame), 1, 12)) AS BIGINT) % len(texts) + 1], '') AS sub_task FROM o
""", EVENTS)
def subtask_pick(spark, sf):
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("text")) for a, b, t in _SPANS])
    return joins.with_sub_task(events(spark, sf).select("episode", "frame", spans.alias("sub_tasks")), 8).drop("sub_tasks")


@query("""
a AS (SELECT episode, floor(max(t) * i / 49) AS "at" FROM ep, range(0, 50) r(i) GROUP BY episode, i),
n AS (SELECT a.episode, "at", frame, abs(t - "at") AS away, row_number() OVER (PARTITION BY a.episode, "at" ORDER BY abs(t - "at"), t, frame) AS r FROM a JOIN ep ON a.episode = ep.episode)
----SELECT episode, "at", frame, round(away, 6) AS away FROM n WHERE r = 1
""", EVENTS)
def nearest_frame(spark, sf):
    df = events(spark, sf)
    ends = df.groupBy("episode").agg(F.max("t").alias("end"))
    asked = ends.select("episode", "end", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("i")).select("episode", F.floor(F.col("end") * F.col("i") / 49).cast("double").alias("at"))
    return joins.nearest_frames(df, asked).select("episode", "at", "frame", r6("away").alias("away"))


@query("""
b AS (SELECT episode, min(index) AS f, max(index) + 1 AS t FROM (SELECT episode, row_number() OVER (ORDER BY episode, frame) - 1 AS index FROM ep) GROUP BY episode)
----SELECT b.episode, i.index - b.f AS frame FROM b JOIN (SELECT row_number() OVER (ORDER BY episode, frame) - 1 AS index FROM ep) i ON i.index >= b.f AND i.index < b.t
""", EVENTS)
def split_consolidated(spark, sf):
    df = vectors.reindexed(events(spark, sf))
    bounds = df.groupBy("episode").agg(F.min("new_index").alias("from"), (F.max("new_index") + 1).alias("to"))
    return joins.sliced_episodes(df.select(F.col("new_index").alias("index")), bounds).select("episode", "frame")


# -- windows ---------------------------------------------------------------------------------------------------------


@query("""
c AS (SELECT episode, frame, length, list(k) OVER (PARTITION BY episode ORDER BY frame ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS c FROM ep)
----SELECT episode, frame, array_to_string(c, ',') AS chunk FROM c WHERE frame + 15 < length
""", EVENTS)
def chunk_contiguous(spark, sf):
    return windows.contiguous(events(spark, sf), "k", 16).select("episode", "frame", nums(F.col("chunk")).alias("chunk"))


@query("""
c AS (SELECT episode, frame, length, lead(k, 2) OVER w AS a, lead(k, 4) OVER w AS b, lead(k, 6) OVER w AS c, lead(k, 8) OVER w AS d, lead(k, 10) OVER w AS e, lead(k, 12) OVER w AS f
  FROM ep WINDOW w AS (PARTITION BY episode ORDER BY frame))
----SELECT episode, frame, concat_ws(',', a, b, c, d, e, f) AS chunk FROM c WHERE frame + 12 < length
""", EVENTS)
def chunk_strided(spark, sf):
    return windows.chunked(events(spark, sf), "k", range(2, 14, 2)).select("episode", "frame", nums(F.col("chunk")).alias("chunk"))


_PADDED = """
p AS (SELECT a.episode, a.frame, d, b.k FROM ep a, (SELECT unnest({offsets}) AS d) o JOIN ep b ON b.episode = a.episode AND b.frame = least(greatest(a.frame + d, 0), a.length - 1))
----SELECT episode, frame, string_agg(k, ',' ORDER BY d) AS chunk FROM p GROUP BY episode, frame
"""


@query(_PADDED.format(offsets="[-3, -1, 0, 2, 5, 9]"), EVENTS)
def chunk_padded(spark, sf):
    return windows.chunked(events(spark, sf), "k", [-3, -1, 0, 2, 5, 9], pad=True).select("episode", "frame", nums(F.col("chunk")).alias("chunk"))


@query(_PADDED.format(offsets="[-4, -2, 0]"), EVENTS)
def history_window(spark, sf):
    return windows.history(events(spark, sf), "k", [-4, -2, 0]).select("episode", "frame", nums(F.col("chunk")).alias("chunk"))


@query(_PADDED.format(offsets="range(0, 8)"), EVENTS)
def replay_chunk(spark, sf):
    return windows.replay_chunk(events(spark, sf), "k", 8).select("episode", "frame", nums(F.col("chunk")).alias("chunk"))


@query("SELECT DISTINCT episode, frame + d AS frame FROM ep, (SELECT unnest([-15, 0, 3]) AS d) o WHERE frame + d >= 0", EVENTS)
def required_frames(spark, sf):
    return windows.required_frames(events(spark, sf), [-15, 0, 3])


@query("""
g AS (SELECT *, CAST(floor(t / 7200 + 1e-5) AS BIGINT) AS gi FROM ep),
n AS (SELECT *, greatest(coalesce(max(gi) OVER (PARTITION BY episode ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), -1) + 1 AS free FROM g)
----SELECT episode, frame, unnest(generate_series(free, gi)) AS grid FROM n WHERE gi >= free
""", EVENTS)
def resample_dt(spark, sf):
    return windows.resampled(events(spark, sf), 7200.0).select("episode", "frame", "grid")


@query("""
q AS (SELECT episode, CASE WHEN i = 9 THEN max(t) ELSE 0.0 + i / 9::DOUBLE * max(t) END AS "at" FROM ep, range(0, 10) r(i) GROUP BY episode, i),
d AS (SELECT * FROM (SELECT episode, t, value, max(t) OVER (PARTITION BY episode ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ep) WHERE top IS NULL OR t > top),
l AS (SELECT q.episode, "at", arg_max(value, t) AS v0, max(t) AS t0 FROM q JOIN d ON d.episode = q.episode AND t <= "at" GROUP BY ALL),
u AS (SELECT q.episode, "at", arg_min(value, t) AS v1, min(t) AS t1 FROM q JOIN d ON d.episode = q.episode AND t >= "at" GROUP BY ALL)
----SELECT episode, round("at", 3) AS "at", round(CASE WHEN t1 > t0 THEN v0 + ("at" - t0) / (t1 - t0) * (v1 - v0) ELSE v0 END, 6) AS v FROM l JOIN u USING (episode, "at")
""", EVENTS)
def joint_interpolation(spark, sf):
    df = events(spark, sf)
    asked = windows.even_times(df, 10)
    out = windows.interpolated(df.select("episode", "frame", "t", F.array("value").alias("v")), asked)
    return out.select("episode", F.round("at", 3).alias("at"), r6(F.col("v")[0]).alias("v"))


# -- action chunks ---------------------------------------------------------------------------------------------------

_CHUNK = """
c AS (SELECT a.episode, a.frame, CAST(b.frame - a.frame AS INTEGER) AS t, b.value AS x, a.value AS ref, lag(b.value) OVER (PARTITION BY a.episode, a.frame ORDER BY b.frame) AS before
  FROM ep a JOIN ep b ON a.episode = b.episode AND b.frame BETWEEN a.frame AND a.frame + 7 WHERE a.frame + 7 < a.length)
"""


def _value_chunks(spark, sf, horizon: int = 8) -> DataFrame:
    return windows.contiguous(events(spark, sf).withColumn("v", F.array("value")), "v", horizon)


def _rows(df: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    return df.select(*keys, F.posexplode(chunk).alias("t", "row")).select(*keys, "t", r6(F.col("row")[0]).alias("x"))


@query(_CHUNK + "----SELECT episode, frame, t, round(x - coalesce(before, ref), 6) + 0.0 AS x FROM c", EVENTS)
def delta_chunk(spark, sf):
    return _rows(_value_chunks(spark, sf), ["episode", "frame"], A.delta(F.col("chunk"), F.col("v")))


@query(_CHUNK + "----SELECT episode, frame, t, round(x - ref, 6) + 0.0 AS x FROM c", EVENTS)
def relative_chunk(spark, sf):
    return _rows(_value_chunks(spark, sf), ["episode", "frame"], A.joint_relative(F.col("chunk"), F.col("v")))


@query(_CHUNK + "----SELECT episode, frame, t, round(x, 6) + 0.0 AS x FROM c", EVENTS)
def absolute_chunk(spark, sf):
    return _rows(_value_chunks(spark, sf), ["episode", "frame"], A.joint_absolute(A.joint_relative(F.col("chunk"), F.col("v")), F.col("v")))


@query("""
e AS (SELECT *, lag(engaged, 1, engaged) OVER w AS before, lag(value, 1, value) OVER w AS v0 FROM ep WINDOW w AS (PARTITION BY episode ORDER BY frame))
----SELECT episode, frame, round(sum(CASE WHEN engaged AND before THEN value - v0 ELSE 0 END) OVER (PARTITION BY episode ORDER BY frame ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS moved FROM e
""", EVENTS)
def engaged_prefix_sum(spark, sf):
    return A.engaged_sums(events(spark, sf), "value", "engaged").select("episode", "frame", r6("moved").alias("moved"))


_HOLD = """
c AS (SELECT a.episode, a.frame, CAST(b.frame - a.frame AS INTEGER) AS t, b.value AS x, b.engaged, a.value AS state FROM ep a JOIN ep b ON a.episode = b.episode AND b.frame BETWEEN a.frame + 1 AND a.frame + 6 WHERE a.frame + 6 < a.length)
----SELECT episode, frame, t - 1 AS t, round(coalesce(last_value(CASE WHEN engaged THEN x END IGNORE NULLS) OVER (PARTITION BY episode, frame ORDER BY t), state), 6) + 0.0 AS held, CASE WHEN engaged THEN x ELSE 0 END AS zeroed FROM c
"""


@query(_HOLD, EVENTS)
def hold_or_zero(spark, sf):
    df = events(spark, sf).withColumn("v", F.array("value"))
    df = windows.chunked(df.withColumn("s", F.struct("v", "engaged")), "s", range(1, 7))
    rows, on = F.transform("chunk", lambda s: s["v"]), F.transform("chunk", lambda s: s["engaged"])
    both = F.arrays_zip(A.held(rows, on, F.col("v")).alias("h"), A.zeroed(rows, on).alias("z"))
    return df.select("episode", "frame", F.posexplode(both).alias("t", "r")).select("episode", "frame", "t", r6(F.col("r.h")[0]).alias("held"), F.col("r.z")[0].alias("zeroed"))


# -- rotations -------------------------------------------------------------------------------------------------------

_QUAT = """
u AS (SELECT episode, frame, vec_id, v, v[1] AS px, v[2] AS py, v[3] AS pz, v[4] / n AS x, v[5] / n AS y, v[6] / n AS z, v[7] / n AS w
  FROM (SELECT *, sqrt(v[4] * v[4] + v[5] * v[5] + v[6] * v[6] + v[7] * v[7]) AS n FROM em)),
m AS (SELECT *, [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)] AS r FROM u)"""
_PAIR = _QUAT + """,
b AS (SELECT a.vec_id, a.px - f.px AS dx, a.py - f.py AS dy, a.pz - f.pz AS dz, a.r AS r, f.r AS s, a.px AS px, a.py AS py, a.pz AS pz FROM m a JOIN m f ON a.episode = f.episode AND f.frame = a.frame - 1)"""
_TURN = "[" + ", ".join(f"s[{i + 1}] * r[{j + 1}] + s[{i + 4}] * r[{j + 4}] + s[{i + 7}] * r[{j + 7}]" for j in range(2) for i in range(3)) + "]"


def _poses(spark, sf) -> DataFrame:
    df = embeddings(spark, sf).withColumn("pose", vectors.sliced(F.col("v"), 0, 7))
    return df.withColumn("ref", F.lag("pose").over(W.partitionBy("episode").orderBy("frame"))).where("ref is not null")


@query(_QUAT + "----SELECT vec_id, CAST(i AS INTEGER) AS i, round([r[1], r[4], r[7], r[2], r[5], r[8]][i + 1], 6) + 0.0 AS x FROM m, range(0, 6) k(i)", EMBEDDINGS)
def quat_to_rot6d(spark, sf):
    return each(embeddings(spark, sf), ["vec_id"], R.rot6d_from_matrix(R.matrix_from_quat(vectors.sliced(F.col("v"), 3, 7))))


@query(_PAIR + f"----SELECT vec_id, CAST(i AS INTEGER) AS i, round(([dx, dy, dz] || {_TURN})[i + 1], 6) + 0.0 AS x FROM b, range(0, 9) k(i)", EMBEDDINGS)
def rel_xyz_rot6d(spark, sf):
    return each(_poses(spark, sf), ["vec_id"], R.relative_pose(F.col("pose"), F.col("ref")))


@query(_PAIR + "----SELECT vec_id, CAST(i AS INTEGER) AS i, round([px, py, pz, r[1], r[4], r[7], r[2], r[5], r[8]][i + 1], 6) + 0.0 AS x FROM b, range(0, 9) k(i)", EMBEDDINGS)
def abs_from_rel(spark, sf):
    relative = R.relative_pose(F.col("pose"), F.col("ref"))
    df = _poses(spark, sf).withColumn("rel", relative)
    p = R.absolute_pose(F.col("rel"), F.col("ref"), ref_kind="quat", kind="rot6d")
    return each(df, ["vec_id"], p)


@query(_PAIR + f"----SELECT vec_id, CAST(i AS INTEGER) AS i, round(([s[1] * dx + s[4] * dy + s[7] * dz, s[2] * dx + s[5] * dy + s[8] * dz, s[3] * dx + s[6] * dy + s[9] * dz] || {_TURN})[i + 1], 6) + 0.0 AS x FROM b, range(0, 9) k(i)", EMBEDDINGS)
def se3_relative(spark, sf):
    return each(_poses(spark, sf), ["vec_id"], R.se3_relative(F.col("pose"), F.col("ref")))


@query(_QUAT + """,
q AS (SELECT *, CASE WHEN w < 0 THEN -1.0 ELSE 1.0 END AS sg, sqrt(x * x + y * y + z * z) AS n FROM m),
h AS (SELECT *, atan2(n, abs(w)) * 0.5 AS g FROM q),
o AS (SELECT vec_id, px, py, pz, sg * x / n * sin(g) AS x, sg * y / n * sin(g) AS y, sg * z / n * sin(g) AS z, cos(g) AS w FROM h)
----SELECT vec_id, CAST(i AS INTEGER) AS i, round([px * 2, py * 2, pz * 2, 1 - 2 * (y * y + z * z), 2 * (x * y + z * w), 2 * (x * z - y * w), 2 * (x * y - z * w), 1 - 2 * (x * x + z * z), 2 * (y * z + x * w)][i + 1], 6) + 0.0 AS x FROM o, range(0, 9) k(i)
""", EMBEDDINGS)
def motion_scale(spark, sf):
    df = embeddings(spark, sf).withColumn("p", F.concat(vectors.sliced(F.col("v"), 0, 3), R.rot6d_from_matrix(R.matrix_from_quat(vectors.sliced(F.col("v"), 3, 7)))))
    return each(df, ["vec_id"], R.scaled_motion(F.col("p"), F.lit(2.0), F.lit(0.5)))


@query("SELECT vec_id, CAST(i AS INTEGER) AS i, round(CASE WHEN i < 3 THEN sin(v[i + 1]) ELSE cos(v[i - 2]) END, 6) + 0.0 AS x FROM em, range(0, 6) k(i)", EMBEDDINGS)
def sincos(spark, sf):
    return each(embeddings(spark, sf), ["vec_id"], R.sin_cos(vectors.sliced(F.col("v"), 0, 3)))


@query("""
e AS (SELECT vec_id, cos(v[1]) AS cx, sin(v[1]) AS sx, cos(v[2]) AS cy, sin(v[2]) AS sy, cos(v[3]) AS cz, sin(v[3]) AS sz FROM em)
----SELECT vec_id, CAST(i AS INTEGER) AS i, round([cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx, sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx, -sy, cy * sx, cy * cx][i + 1], 6) + 0.0 AS x FROM e, range(0, 9) k(i)
""", EMBEDDINGS)
def euler_to_matrix(spark, sf):
    return each(embeddings(spark, sf), ["vec_id"], R.matrix_from_euler(vectors.sliced(F.col("v"), 0, 3)))


@query("SELECT vec_id, CAST(i AS INTEGER) AS i, round(v[i + 1], 6) + 0.0 AS x FROM em, range(0, 3) k(i)", EMBEDDINGS)
def euler_round_trip(spark, sf):
    return each(embeddings(spark, sf), ["vec_id"], R.euler_from_matrix(R.matrix_from_euler(vectors.sliced(F.col("v"), 0, 3))))


@query("SELECT vec_id, CAST(i AS INTEGER) AS i, round(v[i + 1], 6) + 0.0 AS x FROM em, range(0, 3) k(i)", EMBEDDINGS)
def rotvec_round_trip(spark, sf):
    return each(embeddings(spark, sf), ["vec_id"], R.rotvec_from_matrix(R.matrix_from_rotvec(vectors.sliced(F.col("v"), 0, 3))))


@query(_QUAT + "----SELECT vec_id, CAST(i AS INTEGER) AS i, round([x, y, z][i + 1] * 2 * acos(w) / sqrt(1 - w * w), 6) + 0.0 AS x FROM (SELECT vec_id, x, y, z, greatest(least(w, 1.0), -1.0) AS w FROM u), range(0, 3) k(i)", EMBEDDINGS)
def quat_to_axis_angle(spark, sf):
    q = vectors.sliced(F.col("v"), 3, 7)
    unit = F.transform(q, lambda x: x / F.sqrt(F.aggregate(q, F.lit(0.0), lambda s, y: s + y * y)))
    return each(embeddings(spark, sf), ["vec_id"], R.axis_angle_from_quat(unit))


@query("""
g AS (SELECT vec_id, v[1:8] AS a, v[9:16] AS b FROM em)
----SELECT vec_id, round(list_inner_product(a, b) / sqrt(list_inner_product(a, a) * list_inner_product(b, b)), 6) + 0.0 AS cosine FROM g
""", EMBEDDINGS)
def cosine_similarity(spark, sf):
    return embeddings(spark, sf).select("vec_id", r6(R.cosine(vectors.sliced(F.col("v"), 0, 8), vectors.sliced(F.col("v"), 8, 16))).alias("cosine"))


@query("SELECT vec_id, sign(2 * v[1] - 1) * 1.0::DOUBLE AS sign, round(-(2 * v[1] - 1), 6) + 0.0 AS inverted FROM em", EMBEDDINGS)
def gripper_sign(spark, sf):
    g = F.col("v")[0]
    return embeddings(spark, sf).select("vec_id", R.gripper_signed(g).alias("sign"), r6(R.gripper_signed(g, False, True)).alias("inverted"))


_BETWEEN = _QUAT + """,
h AS (SELECT a.vec_id, a.px + {share} * (b.px - a.px) AS px, a.py + {share} * (b.py - a.py) AS py, a.pz + {share} * (b.pz - a.pz) AS pz,
    a.x AS ax, a.y AS ay, a.z AS az, a.w AS aw, CASE WHEN a.x * b.x + a.y * b.y + a.z * b.z + a.w * b.w < 0 THEN -1.0 ELSE 1.0 END AS sg, b.x AS b1, b.y AS b2, b.z AS b3, b.w AS b4,
    acos(least(abs(a.x * b.x + a.y * b.y + a.z * b.z + a.w * b.w), 1.0)) AS g
  FROM u a JOIN u b ON a.episode = b.episode AND b.frame = a.frame + 1),
s AS (SELECT *, sin((1 - {share}) * g) / sin(g) AS ca, sg * sin({share} * g) / sin(g) AS cb FROM h),
q AS (SELECT vec_id, px, py, pz, ca * ax + cb * b1 AS x, ca * ay + cb * b2 AS y, ca * az + cb * b3 AS z, ca * aw + cb * b4 AS w FROM s)
----"""


@query(_BETWEEN.format(share="0.5") + "SELECT vec_id, CAST(i AS INTEGER) AS i, round([1 - 2 * (y * y + z * z), 2 * (x * y + z * w), 2 * (x * z - y * w), 2 * (x * y - z * w), 1 - 2 * (x * x + z * z), 2 * (y * z + x * w)][i + 1], 6) + 0.0 AS x FROM q, range(0, 6) k(i)", EMBEDDINGS)
def slerp_midpoints(spark, sf):
    w = W.partitionBy("episode").orderBy("frame")
    df = embeddings(spark, sf).withColumn("pose", vectors.sliced(F.col("v"), 3, 7)).withColumn("next", F.lead("pose").over(w)).where("next is not null")
    return each(df, ["vec_id"], R.rot6d_from_matrix(R.matrix_from_quat(R.slerp(F.col("pose"), F.col("next"), F.lit(0.5)))))


@query(_BETWEEN.format(share="0.25") + "SELECT vec_id, CAST(i AS INTEGER) AS i, round([px, py, pz, 1 - 2 * (y * y + z * z), 2 * (x * y + z * w), 2 * (x * z - y * w), 2 * (x * y - z * w), 1 - 2 * (x * x + z * z), 2 * (y * z + x * w)][i + 1], 6) + 0.0 AS x FROM q, range(0, 9) k(i)", EMBEDDINGS)
def pose_interpolation(spark, sf):
    df = embeddings(spark, sf).withColumn("t", F.col("frame").cast("double"))
    df = df.withColumn("pose", P.pose_from(vectors.sliced(F.col("v"), 0, 3), vectors.sliced(F.col("v"), 3, 7), "quat"))
    top = df.select("episode", "frame", "vec_id").withColumn("next", F.lead("vec_id").over(W.partitionBy("episode").orderBy("frame"))).where("next is not null")
    asked = top.select("episode", (F.col("frame") + 0.25).alias("at"))
    out = windows.interpolated(df.select("episode", "frame", "t", F.col("pose").alias("v")), asked, blend=P.blended)
    out = out.join(top.select(F.col("episode").alias("e"), (F.col("frame") + 0.25).alias("a"), "vec_id"), (F.col("episode") == F.col("e")) & (F.col("at") == F.col("a")))
    return each(out, ["vec_id"], "v")


def _product(a: str, b: str) -> str:
    return "[" + ", ".join(" + ".join(f"{a}[{3 * i + k + 1}] * {b}[{3 * k + j + 1}]" for k in range(3)) for i in range(3) for j in range(3)) + "]"


_TURNED = "[" + ", ".join(f"p.s[{i + 1}] * p.r[{j + 1}] + p.s[{i + 4}] * p.r[{j + 4}] + p.s[{i + 7}] * p.r[{j + 7}]" for i in range(3) for j in range(3)) + "]"


@query(_QUAT + f""",
n AS (SELECT *, vec_id % 3 <> 0 AS engaged, count(*) OVER (PARTITION BY episode) AS n FROM m),
p AS (SELECT b.episode, b.frame, b.px - a.px AS dx, b.py - a.py AS dy, b.pz - a.pz AS dz, a.r AS s, b.r AS r, a.engaged AND b.engaged AS on_ FROM n a JOIN n b ON a.episode = b.episode AND b.frame = a.frame + 1),
c AS (SELECT vec_id, episode, frame, 0 AS t, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z, [1, 0, 0, 0, 1, 0, 0, 0, 1]::DOUBLE[] AS q FROM n WHERE frame + 8 < n
  UNION ALL SELECT c.vec_id, c.episode, c.frame, c.t + 1, c.x + CASE WHEN on_ THEN dx ELSE 0 END, c.y + CASE WHEN on_ THEN dy ELSE 0 END, c.z + CASE WHEN on_ THEN dz ELSE 0 END,
    CASE WHEN on_ THEN (SELECT {_product("g.q", "g.d")} FROM (SELECT c.q AS q, {_TURNED} AS d) g) ELSE c.q END FROM c JOIN p ON p.episode = c.episode AND p.frame = c.frame + c.t + 1 WHERE c.t < 8)
----SELECT vec_id, CAST(t - 1 AS INTEGER) AS t, CAST(i AS INTEGER) AS i, round([x, y, z, q[1], q[4], q[7], q[2], q[5], q[8]][i + 1], 6) + 0.0 AS x FROM c, range(0, 9) k(i) WHERE t > 0
""", EMBEDDINGS.replace("em AS", "RECURSIVE em AS", 1))
def rotation_prefix(spark, sf):
    df = embeddings(spark, sf).withColumn("s", F.struct(vectors.sliced(F.col("v"), 0, 7).alias("p"), (F.col("vec_id") % 3 != 0).alias("on")))
    df = windows.chunked(df, "s", range(1, 9))
    rows = A.engaged_rel_xyz_rot6d(F.transform("chunk", lambda s: s["p"]), F.transform("chunk", lambda s: s["on"]), F.col("s.p"), F.col("s.on"))
    return df.select("vec_id", F.posexplode(rows).alias("t", "row")).select("vec_id", "t", F.posexplode("row").alias("i", "x")).withColumn("x", r6("x"))


@query("""
a AS (SELECT vec_id, list(1 - 2 * (v[1] + 0.5)) OVER (PARTITION BY episode ORDER BY frame ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS r FROM em),
c AS (SELECT vec_id, r, 0 AS i, 0.0::DOUBLE AS out_, 0.0::DOUBLE AS held, 0 AS left_ FROM a
  UNION ALL SELECT vec_id, r, i + 1, CASE WHEN left_ > 0 THEN held ELSE r[i + 1] END, CASE WHEN left_ = 0 AND abs(r[i + 1]) > 0.5 THEN r[i + 1] ELSE held END,
    CASE WHEN left_ > 0 THEN left_ - 1 WHEN abs(r[i + 1]) > 0.5 THEN 3 ELSE 0 END FROM c WHERE i < len(r))
----SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(out_, 6) + 0.0 AS x FROM c WHERE i > 0
""", EMBEDDINGS.replace("em AS", "RECURSIVE em AS", 1))
def sticky_gripper(spark, sf):
    w = W.partitionBy("episode").orderBy("frame").rowsBetween(0, 15)
    df = embeddings(spark, sf).withColumn("a", F.collect_list(F.col("v")[0] + 0.5).over(w))
    return each(df, ["vec_id"], R.sticky_gripper(F.col("a"), 4))


@query("SELECT vec_id, CASE WHEN v[1] > 0.5 THEN 1.0::DOUBLE ELSE -1.0 END AS opened, round(1 - v[1], 6) AS closed FROM em", EMBEDDINGS)
def gripper_states(spark, sf):
    g = F.col("v")[0]
    return embeddings(spark, sf).select("vec_id", R.gripper_opened(g).alias("opened"), r6(R.closedness(g)).alias("closed"))


@query("""
u AS (SELECT vec_id, v[4] / n AS w, v[5] / n AS x, v[6] / n AS y, v[7] / n AS z FROM (SELECT *, sqrt(v[4] * v[4] + v[5] * v[5] + v[6] * v[6] + v[7] * v[7]) AS n FROM em)),
m AS (SELECT vec_id, 2 * (x * z + y * w) AS r0, 2 * (y * z - x * w) AS r3, 1 - 2 * (x * x + y * y) AS r6, 2 * (y * z + x * w) AS z1, 2 * (x * z - y * w) AS z0, 2 * (x * y + z * w) AS y0, 1 - 2 * (x * x + z * z) AS y1, 1 - 2 * (y * y + z * z) AS x0, 2 * (x * y - z * w) AS x1 FROM u)
----SELECT vec_id, CAST(i AS INTEGER) AS i, round([atan2(z1, -z0), atan2(-r6, sqrt(r0 * r0 + r3 * r3)), atan2(r3, r0)][i + 1], 6) + 0.0 AS x FROM m, range(0, 3) k(i)
""", EMBEDDINGS)
def euler_in_frame(spark, sf):
    return each(embeddings(spark, sf), ["vec_id"], R.euler_in_frame(vectors.sliced(F.col("v"), 3, 7), [0, 0, 1, 0, 1, 0, -1, 0, 0]))


@query("""
g AS (SELECT vec_id, v[1:8] AS a, v[9:16] AS b FROM em)
----SELECT vec_id, round(sqrt(list_sum([(a[d] - b[d]) * (a[d] - b[d]) for d in range(1, 9)]) / 8), 6) AS rmse, round(list_sum([abs(a[d] - b[d]) for d in range(1, 9)]) / 8, 6) AS l1 FROM g
""", EMBEDDINGS)
def vector_distances(spark, sf):
    a, b = vectors.sliced(F.col("v"), 0, 8), vectors.sliced(F.col("v"), 8, 16)
    return embeddings(spark, sf).select("vec_id", r6(R.rmse(a, b)).alias("rmse"), r6(R.l1(a, b)).alias("l1"))


@query("SELECT vec_id, CAST(i AS INTEGER) AS i, round(v[i + 1], 6) + 0.0 AS x FROM em, range(0, 6) k(i)", EMBEDDINGS)
def layout_round_trip(spark, sf):
    """Translation and rotation vector to a pose, to a homogeneous matrix, and back."""
    pose = P.pose_of(vectors.sliced(F.col("v"), 0, 6), Layout.XYZ_ROTVEC)
    back = P.row_of(P.pose_of(P.row_of(pose, Layout.DEFAULT), Layout.DEFAULT), Layout.XYZ_ROTVEC)
    return each(embeddings(spark, sf), ["vec_id"], back)


@query("""
e AS (SELECT vec_id, v[1] AS px, v[2] AS py, v[3] AS pz, radians(v[4] * 90) AS a, radians(v[5] * 90) AS b, radians(v[6] * 90) AS c FROM em)
----SELECT vec_id, CAST(i AS INTEGER) AS i, round([px, py, pz, cos(c) * cos(b), sin(c) * cos(b), -sin(b), cos(c) * sin(b) * sin(a) - sin(c) * cos(a), sin(c) * sin(b) * sin(a) + cos(c) * cos(a), cos(b) * sin(a)][i + 1], 6) + 0.0 AS x FROM e, range(0, 9) k(i)
""", EMBEDDINGS)
def pose_from_degrees(spark, sf):
    angles = F.transform(vectors.sliced(F.col("v"), 3, 6), lambda x: x * 90)
    return each(embeddings(spark, sf), ["vec_id"], P.pose_from(vectors.sliced(F.col("v"), 0, 3), angles, "euler"))


# -- normalisation ---------------------------------------------------------------------------------------------------

_DIMS = "s AS (SELECT d, min(v[d]) AS lo, max(v[d]) AS hi, avg(v[d]) AS m, stddev_pop(v[d]) AS sd FROM em, range(1, 7) k(d) GROUP BY d)\n----"


def _with_stats(spark, sf) -> DataFrame:
    df = embeddings(spark, sf).withColumn("x", vectors.sliced(F.col("v"), 0, 6))
    own = [F.array(*[f(F.col("x")[i]) for i in range(6)]).alias(n) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))]
    # One row of statistics, aggregated on the executors.
    return df.join(F.broadcast(df.agg(*own)))


@query(_DIMS + "SELECT vec_id, CAST(d - 1 AS INTEGER) AS i, round(2 * (v[d] - lo) / (hi - lo) - 1, 6) + 0.0 AS x FROM em, s", EMBEDDINGS)
def normalize_minmax(spark, sf):
    return each(_with_stats(spark, sf), ["vec_id"], N.minmax(F.col("x"), F.col("min"), F.col("max")))


@query(_DIMS + "SELECT vec_id, CAST(d - 1 AS INTEGER) AS i, round((greatest(least(v[d] * 3, 1.0), -1.0) + 1) / 2 * (hi - lo) + lo, 6) + 0.0 AS x FROM em, s", EMBEDDINGS)
def denormalize_minmax(spark, sf):
    return each(_with_stats(spark, sf), ["vec_id"], N.from_minmax(F.transform("x", lambda v: v * 3), F.col("min"), F.col("max")))


@query(_DIMS + "SELECT vec_id, CAST(d - 1 AS INTEGER) AS i, round(greatest(least(CASE WHEN sd = 0 THEN v[d] ELSE (v[d] - m) / sd END, 5.0), -5.0), 6) + 0.0 AS x FROM em, s", EMBEDDINGS)
def normalize_meanstd(spark, sf):
    return each(_with_stats(spark, sf), ["vec_id"], N.mean_std(F.col("x"), F.col("mean"), F.col("std")))


@query(_DIMS + "SELECT vec_id, CAST(d - 1 AS INTEGER) AS i, round(CASE WHEN sd = 0 THEN v[d] ELSE v[d] * sd + m END, 6) + 0.0 AS x FROM em, s", EMBEDDINGS)
def denormalize_meanstd(spark, sf):
    return each(_with_stats(spark, sf), ["vec_id"], N.from_mean_std(F.col("x"), F.col("mean"), F.col("std")))


# -- language --------------------------------------------------------------------------------------------------------


@query(r"SELECT conv_id, turn, regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', '', 'g') AS text FROM conversations")
def formalize_language(spark, sf):
    return spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", L.formalised(F.col("text")).alias("text"))


_INSTRUMENTS = {0: "Grasper", 1: "Scissors", 2: "Hook"}
_COLORS = {0: "red", 1: "green", 2: "blue", 3: "yellow"}


@query("""
SELECT episode, frame, 'arm left: ' || CAST(round_even(k / 7, 0) AS INTEGER) || '. left instrument: ' ||
  CASE CAST(round_even(k / 20, 0) AS INTEGER) WHEN 0 THEN 'Grasper' WHEN 1 THEN 'Scissors' WHEN 2 THEN 'Hook' ELSE 'Instrument' END || ' (' ||
  CASE CAST(round_even(k / 10 - 1, 0) AS INTEGER) WHEN 0 THEN 'red' WHEN 1 THEN 'green' WHEN 2 THEN 'blue' WHEN 3 THEN 'yellow' ELSE 'None' END || '). ' || kind AS prompt
FROM ep
""", EVENTS)
def state_prompt(spark, sf):
    k = F.col("k").cast("double")
    arm = L.arm_prompt("left", k / 7, L.named(k / 20, _INSTRUMENTS, "Instrument"), L.named(k / 10 - 1, _COLORS, "None"))
    return events(spark, sf).select("episode", "frame", L.state_prompt([arm], F.col("kind")).alias("prompt"))


@query("""
SELECT episode, frame, 'left: ' || CASE WHEN kind = 'error' THEN 'none' ELSE kind END || CASE WHEN linked = 0 THEN '. go on' ELSE '' END AS prompt FROM ep
""", EVENTS)
def tool_prompt(spark, sf):
    tool = F.when(F.col("kind") == "error", F.lit(" NaN ")).otherwise(F.concat(F.lit("  "), F.upper("kind")))
    return events(spark, sf).select("episode", "frame", L.tool_prompt([("left", tool)], F.when(F.col("linked") == 0, F.lit("go on")).otherwise(F.lit("None"))).alias("prompt"))


@query("SELECT DISTINCT episode, printf('data/chunk-%03d/episode_%06d.parquet', CAST(episode // 100 AS BIGINT), CAST(episode AS BIGINT)) AS path FROM ep", EVENTS)
def episode_paths(spark, sf):
    return events(spark, sf).select("episode").distinct().select("episode", L.numbered_path("data/chunk-%03d/episode_%06d.parquet", F.floor(F.col("episode") / 100), F.col("episode")).alias("path"))


# -- statistics ------------------------------------------------------------------------------------------------------

_STATS = "round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) + 0.0 AS std, round(min(x), 6) + 0.0 AS min, round(max(x), 6) + 0.0 AS max"


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[r6(c).alias(c) for c in df.columns if c not in keys])


@query(f"""
l AS (SELECT 'embedding' AS feature, CAST(d - 1 AS INTEGER) AS dim, v[d] AS x FROM em, range(1, 65) k(d))
----SELECT feature, dim, {_STATS}, round(quantile_cont(x, 0.01), 6) + 0.0 AS q01, round(quantile_cont(x, 0.99), 6) + 0.0 AS q99 FROM l GROUP BY ALL
""", EMBEDDINGS)
def flat_stats(spark, sf):
    return _rounded(stats.flat_stats(embeddings(spark, sf), {"embedding": "v"}), "feature", "dim")


_QUANTILES = ", ".join(f"round(quantile_cont(x, {p}), 6) + 0.0 AS {n}" for n, p in (("q01", 0.01), ("q02", 0.02), ("q98", 0.98), ("q99", 0.99)))


@query(f"""
c AS (SELECT 'action' AS key, CAST(b.frame - a.frame AS INTEGER) AS t, 0 AS dim, b.value - a.value AS x FROM ep a JOIN ep b ON a.episode = b.episode AND b.frame BETWEEN a.frame AND a.frame + 15 WHERE a.frame + 15 < a.length)
----SELECT key, t, dim, {_STATS}, {_QUANTILES} FROM c GROUP BY ALL
""", EVENTS)
def temporal_stats(spark, sf):
    df = events(spark, sf).withColumn("a", F.array("value"))
    return _rounded(stats.temporal_stats(df, "a", range(16), reference="a"), "key", "t", "dim")


@query(f"""
c AS (SELECT 'action' AS key, CAST((b.frame - a.frame - 2) // 2 AS INTEGER) AS t, 0 AS dim, b.value AS x FROM ep a JOIN ep b ON a.episode = b.episode AND b.frame BETWEEN a.frame + 2 AND a.frame + 16 AND (b.frame - a.frame) % 2 = 0 WHERE a.frame + 16 < a.length)
----SELECT key, t, dim, {_STATS}, {_QUANTILES} FROM c GROUP BY ALL
""", EVENTS)
def absolute_temporal_stats(spark, sf):
    df = events(spark, sf).withColumn("a", F.array("value"))
    return _rounded(stats.temporal_stats(df, "a", range(2, 18, 2)), "key", "t", "dim")


@query(_QUAT + f""",
p AS (SELECT a.vec_id, CAST(g.frame - a.frame AS INTEGER) AS t, g.px - a.px AS dx, g.py - a.py AS dy, g.pz - a.pz AS dz, g.r AS r, a.r AS s
  FROM m a JOIN m g ON a.episode = g.episode AND g.frame BETWEEN a.frame AND a.frame + 3 JOIN (SELECT episode, count(*) AS n FROM em GROUP BY episode) c ON c.episode = a.episode WHERE a.frame + 3 < n),
l AS (SELECT 'eef' AS key, t, CAST(i AS INTEGER) AS dim, ([s[1] * dx + s[4] * dy + s[7] * dz, s[2] * dx + s[5] * dy + s[8] * dz, s[3] * dx + s[6] * dy + s[9] * dz] || {_TURN})[i + 1] AS x FROM p, range(0, 9) k(i))
----SELECT key, t, dim, {_STATS}, round(quantile_cont(x, 0.01), 6) + 0.0 AS q01, round(quantile_cont(x, 0.99), 6) + 0.0 AS q99 FROM l GROUP BY ALL
""", EMBEDDINGS)
def relative_stats(spark, sf):
    df = embeddings(spark, sf).withColumn("p", vectors.sliced(F.col("v"), 0, 7))
    chunks = windows.contiguous(df, "p", 4).select(A.se3_chunk(F.col("chunk"), F.col("p")).alias("chunk"))
    return _rounded(stats.stats_over_chunks(chunks, F.lit("eef"), "chunk", (0.01, 0.99)), "key", "t", "dim")


@query(f"""
l AS (SELECT linenumber AS grp, x FROM (SELECT CAST(frame % 3 AS INTEGER) AS linenumber, price AS x FROM od))
----SELECT grp, {_QUANTILES} FROM l GROUP BY grp
""", ORDERS)
def ranked_percentiles(spark, sf):
    df = orders(spark, sf).select((F.col("frame") % 3).cast("int").alias("grp"), "price")
    return _rounded(stats.ranked_percentiles(df, ["grp"], "price", stats.TEMPORAL), "grp")


@query("SELECT CAST(count(*) AS BIGINT) AS anchors, CAST(sum(frame) AS BIGINT) AS frames FROM (SELECT frame, count(*) OVER (PARTITION BY episode) AS n FROM od) WHERE frame + 1 < n", ORDERS)
def short_episode_anchors(spark, sf):
    return filters.effective_anchors(orders(spark, sf), range(2)).agg(F.count("*").alias("anchors"), F.sum("frame").alias("frames"))


_PARTS = """
g AS (SELECT kind AS dataset, CAST(length(kind) AS DOUBLE) AS weight, value AS x FROM ep),
a AS (SELECT dataset, any_value(weight) AS w, avg(x) AS m, stddev_pop(x) AS sd, min(x) AS x0, quantile_cont(x, 0.01) AS x1, quantile_cont(x, 0.02) AS x2, quantile_cont(x, 0.98) AS x3, quantile_cont(x, 0.99) AS x4, max(x) AS x5 FROM g GROUP BY dataset),
n AS (SELECT *, w / sum(w) OVER () AS u FROM a)"""


def _parts(spark, sf) -> DataFrame:
    df = events(spark, sf).select(F.col("kind").alias("dataset"), "value")
    return stats.summarised(df, ["dataset"], "value", stats.TEMPORAL).withColumn("weight", F.length("dataset").cast("double")).withColumn("key", F.lit("value"))


@query(_PARTS + "----SELECT 'value' AS key, round(sum(u * m), 6) AS mean, round(sqrt(sum(u * (sd * sd + m * m)) - sum(u * m) * sum(u * m)), 6) AS std, round(min(x0), 6) AS min, round(max(x5), 6) AS max FROM n", EVENTS)
def merge_moments(spark, sf):
    return _rounded(merge.merge_moments(_parts(spark, sf), ["key"]), "key")


@query(_PARTS + """,
raw AS (SELECT dataset, u, unnest([x0, x1, x2, x3, x4, x5]) AS x, unnest([0, 0.01, 0.02, 0.98, 0.99, 1]::DOUBLE[]) AS p FROM n),
kn AS (SELECT dataset, any_value(u) AS u, x, max(p) AS p FROM raw GROUP BY dataset, x),
seg AS (SELECT *, lead(x) OVER w AS xn, lead(p) OVER w AS pn, min(x) OVER (PARTITION BY dataset) AS lo, max(x) OVER (PARTITION BY dataset) AS hi FROM kn WINDOW w AS (PARTITION BY dataset ORDER BY x)),
grid AS (SELECT DISTINCT x AS gx FROM kn),
cdf AS (SELECT gx, any_value(u) AS u, max(CASE WHEN gx >= hi THEN 1.0::DOUBLE WHEN gx < lo THEN 0.0 WHEN gx >= x AND gx < xn THEN p + (gx - x) / (xn - x) * (pn - p) END) AS c FROM grid, seg GROUP BY gx, dataset),
mixed AS (SELECT gx, sum(u * c) AS f FROM cdf GROUP BY gx),
mono AS (SELECT gx, max(f) OVER (ORDER BY gx) AS g0, row_number() OVER (ORDER BY gx) AS r, count(*) OVER () AS n FROM mixed),
fin AS (SELECT gx, CASE WHEN r = 1 THEN 0.0 WHEN r = n THEN 1.0 ELSE g0 END AS g FROM mono),
st AS (SELECT gx, g, lag(gx) OVER (ORDER BY gx) AS bx, lag(g) OVER (ORDER BY gx) AS bg FROM fin),
q AS (SELECT p, min(bx + (p - bg) / (g - bg) * (gx - bx)) AS v FROM st, (SELECT unnest([0.01, 0.02, 0.98, 0.99]::DOUBLE[]) AS p) WHERE g >= p AND bg < p GROUP BY p)
----SELECT 'value' AS key, round(max(CASE WHEN p = 0.01 THEN v END), 6) AS q01, round(max(CASE WHEN p = 0.02 THEN v END), 6) AS q02, round(max(CASE WHEN p = 0.98 THEN v END), 6) AS q98, round(max(CASE WHEN p = 0.99 THEN v END), 6) AS q99 FROM q
""", EVENTS)
def merge_quantiles(spark, sf):
    return _rounded(merge.merge_quantiles(_parts(spark, sf), ["key"]), "key")


# -- sharding --------------------------------------------------------------------------------------------------------


@query("""
SELECT episode, frame, CAST((row_number() OVER (PARTITION BY episode ORDER BY (frame * 37) % 101, frame) - 1) % 10 AS INTEGER) AS piece FROM ep
""", EVENTS)
def shard_pieces(spark, sf):
    df = events(spark, sf)
    return df.select("episode", "frame", sharding.piece([(F.col("frame") * 37) % 101, "frame"], 10).alias("piece"))


_PIECES = """
a AS (SELECT episode, frame FROM ep WHERE frame + 15 < length),
p AS (SELECT episode, frame, CAST((row_number() OVER (PARTITION BY episode ORDER BY CAST(('0x' || substr(md5('0:' || episode || ':' || frame), 1, 12)) AS BIGINT), frame) - 1) % 10 AS INTEGER) AS piece FROM a)"""


@query(_PIECES + "----SELECT episode, frame, piece FROM p", EVENTS)
def shard_plan(spark, sf):
    """Pieces as the plan deals them; the shards, a sequential greedy choice, are held against a loop in the tests."""
    plan, _ = sharding.shard_plan(filters.effective_anchors(events(spark, sf), range(16)), 1024, 0.1)
    return plan.where("shard is not null").select("episode", "frame", "piece")


@query(_PIECES + """,
n AS (SELECT episode, piece, count(*) AS n FROM p GROUP BY ALL)
----SELECT CAST(least(greatest(1, ceil(sum(n) / 1024)), count(DISTINCT episode) * 10) AS BIGINT) AS shards, CAST(sum(n) AS BIGINT) AS total, true AS even FROM n
""", EVENTS)
def shard_plan_balance(spark, sf):
    """Greedy placement leaves no two shards further apart than the largest piece."""
    plan, lengths = sharding.shard_plan(filters.effective_anchors(events(spark, sf), range(16)), 1024, 0.1)
    largest = plan.groupBy("episode", "piece").agg(F.count("*").alias("n")).agg(F.max("n").alias("largest"))
    sums = lengths.agg(F.count("*").alias("shards"), F.sum("length").alias("total"), (F.max("length") - F.min("length")).alias("apart"))
    return sums.join(F.broadcast(largest)).select("shards", "total", (F.col("apart") <= F.col("largest")).alias("even"))


@query("SELECT event_id, CAST(event_id % 6 // 3 AS INTEGER) AS rank, CAST(event_id % 6 % 3 AS INTEGER) AS worker FROM events")
def worker_split(spark, sf):
    return sharding.worker_split(spark.read.parquet(f"{sf}/events.parquet").select("event_id"), "event_id", 2, 3)


@query("""
d AS (SELECT kind AS dataset, linked AS grp, count(*) AS shards FROM ep GROUP BY ALL)
----SELECT dataset, grp, round(shards / sum(shards) OVER (PARTITION BY grp) * (grp + 1), 6) AS weight FROM d
""", EVENTS)
def dataset_weights(spark, sf):
    df = events(spark, sf).groupBy(F.col("kind").alias("dataset"), F.col("linked").alias("grp")).agg(F.count("*").alias("shards")).withColumn("mix_ratio", F.col("grp") + 1.0)
    return sharding.dataset_weights(df).select("dataset", "grp", r6("weight").alias("weight"))


_DATASETS = """
d AS (SELECT kind AS dataset, avg(length) AS mean_length, count(DISTINCT episode) AS shards, CAST(length(kind) AS DOUBLE) AS weight FROM ep GROUP BY kind),
p AS (SELECT *, weight / mean_length / sum(weight / mean_length) OVER () AS p FROM d),
c AS (SELECT *, sum(p) OVER (ORDER BY dataset) AS upto, row_number() OVER (ORDER BY dataset DESC) AS last FROM p)"""


def _datasets(spark, sf) -> DataFrame:
    return events(spark, sf).groupBy(F.col("kind").alias("dataset")).agg(F.avg("length").alias("mean_length"), F.countDistinct("episode").alias("shards")).withColumn("weight", F.length("dataset").cast("double"))


@query(_DATASETS + """,
u AS (SELECT i AS draw, (CAST(('0x' || substr(md5('3:' || i), 1, 12)) AS BIGINT) + 0.5) / 281474976710656 AS u FROM range(0, 5000) r(i)),
x AS (SELECT draw, arg_min(dataset, upto) AS dataset FROM u JOIN c ON u < upto OR last = 1 GROUP BY draw),
k AS (SELECT draw, x.dataset, shards, row_number() OVER (PARTITION BY x.dataset ORDER BY draw) - 1 AS k FROM x JOIN d ON d.dataset = x.dataset),
deck AS (SELECT dataset, cycle, s AS shard, row_number() OVER (PARTITION BY dataset, cycle ORDER BY CAST(('0x' || substr(md5('4:' || dataset || ':' || cycle || ':' || s), 1, 12)) AS BIGINT), s) - 1 AS turn
  FROM (SELECT DISTINCT dataset, k // shards AS cycle, unnest(range(0, shards)) AS s FROM k))
----SELECT draw, k.dataset, CAST(deck.cycle AS INTEGER) AS cycle, CAST(deck.shard AS INTEGER) AS shard FROM k JOIN deck ON deck.dataset = k.dataset AND deck.cycle = k // shards AND deck.turn = k % shards
""", EVENTS)
def shard_schedule(spark, sf):
    return sharding.schedule(_datasets(spark, sf), 5000, seed=1, epoch=2)


@query(_DATASETS + """,
u AS (SELECT e AS epoch, i AS draw, (CAST(('0x' || substr(md5((5 + e) || ':' || i), 1, 12)) AS BIGINT) + 0.5) / 281474976710656 AS u FROM range(0, 3) f(e), range(0, 2000) r(i) WHERE e * 2000 + i < 4500),
x AS (SELECT epoch, draw, arg_min(dataset, upto) AS dataset FROM u JOIN c ON u < upto OR last = 1 GROUP BY epoch, draw),
k AS (SELECT epoch, draw, x.dataset, shards, row_number() OVER (PARTITION BY epoch, x.dataset ORDER BY draw) - 1 AS k FROM x JOIN d ON d.dataset = x.dataset),
deck AS (SELECT epoch, dataset, cycle, s AS shard, row_number() OVER (PARTITION BY epoch, dataset, cycle ORDER BY CAST(('0x' || substr(md5((6 + epoch) || ':' || dataset || ':' || cycle || ':' || s), 1, 12)) AS BIGINT), s) - 1 AS turn
  FROM (SELECT DISTINCT epoch, dataset, k // shards AS cycle, unnest(range(0, shards)) AS s FROM k))
----SELECT CAST(k.epoch AS INTEGER) AS epoch, draw, k.dataset, CAST(deck.cycle AS INTEGER) AS cycle, CAST(deck.shard AS INTEGER) AS shard FROM k JOIN deck ON deck.epoch = k.epoch AND deck.dataset = k.dataset AND deck.cycle = k // shards AND deck.turn = k % shards
""", EVENTS)
def endless_schedule(spark, sf):
    """A stream of draws, stopped and started again twice: 1500 draws each, over two ends of an epoch."""
    path = f"{shared_folder(spark)}/schedule-{uuid.uuid4().hex[:12]}"
    for _ in range(3):
        stream = schedules.endless(spark, _datasets(spark, sf), f"{path}/progress.json", draws_per_epoch=2000, seed=5, batch=1500, partitions=2)
        stream.writeStream.format("parquet").option("path", f"{path}/draws").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("epoch int, draw long, dataset string, cycle int, shard int").parquet(f"{path}/draws")


@query(_DATASETS + "----SELECT row_number() OVER (ORDER BY dataset, s) - 1 AS draw, dataset, CAST(s AS INTEGER) AS shard FROM (SELECT dataset, unnest(range(0, shards)) AS s FROM d)", EVENTS)
def evaluation_schedule(spark, sf):
    return sharding.evaluation_schedule(_datasets(spark, sf))


@query(_DATASETS + "----SELECT dataset, 'ucb_dvrk' AS tag, CAST(shards AS BIGINT) AS length, round(weight / sum(weight) OVER () * 100, 6) AS mix_percent FROM d", EVENTS)
def mixture_summary(spark, sf):
    return sharding.mixture_summary(_datasets(spark, sf).withColumn("tag", F.lit("ucb_dvrk"))).withColumn("mix_percent", r6("mix_percent"))


@query("SELECT episode, frame, row_number() OVER (PARTITION BY episode % 7 ORDER BY CAST(('0x' || substr(md5('5:' || episode || ':' || frame), 1, 12)) AS BIGINT), episode, frame) - 1 AS place FROM ep", EVENTS)
def shard_shuffle(spark, sf):
    df = events(spark, sf).withColumn("shard", F.col("episode") % 7)
    return sharding.shuffled(df, 5).select("episode", "frame", F.col("place").cast("long").alias("place"))


@query("SELECT CAST(sum(length) AS BIGINT) AS total, round(avg(length), 6) AS mean, round(stddev_pop(length), 6) AS std FROM (SELECT episode, count(*) AS length FROM ep GROUP BY episode)", EVENTS)
def shard_balance(spark, sf):
    return sharding.shard_balance(events(spark, sf).groupBy("episode").agg(F.count("*").alias("length"))).select("total", r6("mean").alias("mean"), r6("std").alias("std"))


# -- metrics ---------------------------------------------------------------------------------------------------------


@query("""
p AS (SELECT episode, value - lag(value, 1, 0) OVER (PARTITION BY episode ORDER BY frame) AS d FROM ep)
----SELECT episode, round(avg(d * d), 6) AS mse, round(avg(abs(d)), 6) AS mae FROM p GROUP BY episode
""", EVENTS)
def open_loop_error(spark, sf):
    before = F.lag("value", 1, 0.0).over(W.partitionBy("episode").orderBy("frame"))
    df = events(spark, sf).select("episode", F.array("value").alias("a"), F.array(before).alias("p"))
    return metrics.open_loop_error(df, "a", "p").select("episode", r6("mse").alias("mse"), r6("mae").alias("mae"))


@query("""
c AS (SELECT episode, frame, value, lead(value, 1) OVER w AS b, lead(value, 2) OVER w AS c, lead(value, 3) OVER w AS d, length FROM ep WINDOW w AS (PARTITION BY episode ORDER BY frame))
----SELECT episode, frame, round((abs(c - 2 * b + value) + abs(d - 2 * c + b)) / 2, 6) AS acceleration FROM c WHERE frame + 3 < length
""", EVENTS)
def intra_accel(spark, sf):
    return _value_chunks(spark, sf, 4).select("episode", "frame", r6(metrics.intra_acceleration(F.col("chunk"))).alias("acceleration"))


_STEPS = """
c AS (SELECT episode, frame, value AS a, lead(value, 1) OVER w AS b, lead(value, 2) OVER w AS c, length FROM ep WINDOW w AS (PARTITION BY episode ORDER BY frame)),
n AS (SELECT *, lead(a) OVER (PARTITION BY episode ORDER BY frame) AS na, lead(b) OVER (PARTITION BY episode ORDER BY frame) AS nb FROM c WHERE frame + 3 < length AND frame % 3 = 0)
----"""


def _every_third(spark, sf) -> DataFrame:
    return _value_chunks(spark, sf, 4).where("frame % 3 = 0")


@query(_STEPS + "SELECT episode, frame, round(abs(na - c), 6) AS jump FROM n WHERE na IS NOT NULL", EVENTS)
def boundary_jump(spark, sf):
    return metrics.boundary_jumps(_every_third(spark, sf), 3).where("jump is not null").select("episode", "frame", r6("jump").alias("jump"))


@query(_STEPS + "SELECT episode, frame, round((c - b) * (nb - na) / (abs(c - b) * abs(nb - na) + 1e-8), 6) + 0.0 AS momentum FROM n WHERE na IS NOT NULL", EVENTS)
def momentum_shift(spark, sf):
    return metrics.momentum(_every_third(spark, sf), 3).where("momentum is not null").select("episode", "frame", r6("momentum").alias("momentum"))


@query("""
s AS (SELECT episode AS env, frame AS step, value AS reward, kind = 'purchase' AS success, k / 100 AS q, t AS progress, k < 95 AS valid, done, coalesce(sum(CAST(done AS INTEGER)) OVER (PARTITION BY episode ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rollout FROM ep)
----SELECT env, CAST(rollout AS BIGINT) AS rollout, CAST(count(*) AS BIGINT) AS length, bool_or(success) AS success, round(sum(reward), 4) AS reward, max(q) AS q_score, round(arg_max(progress, step), 6) AS progress, bool_and(valid) AS valid, bool_or(done) AS complete FROM s GROUP BY env, rollout
""", EVENTS)
def rollout_success(spark, sf):
    steps = events(spark, sf).select(F.col("episode").alias("env"), F.col("frame").alias("step"), F.col("value").alias("reward"), (F.col("kind") == "purchase").alias("success"), (F.col("k") / 100).alias("q_score"), F.col("t").alias("progress"), (F.col("k") < 95).alias("valid"), "done")
    out = metrics.rollouts(steps)
    return out.withColumn("rollout", F.col("rollout").cast("long")).withColumn("reward", F.round("reward", 4)).withColumn("progress", r6("progress"))


@query("""
s AS (SELECT episode AS env, frame // 5 AS grp, frame, value, done, coalesce(max(CAST(done AS INTEGER)) OVER (PARTITION BY episode, frame // 5 ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM ep)
----SELECT env, grp AS "group", round(sum(value), 4) AS reward, bool_or(done) AS done, CAST(count(*) AS BIGINT) AS steps FROM s WHERE o = 0 GROUP BY env, grp
""", EVENTS)
def multi_step_rewards(spark, sf):
    steps = events(spark, sf).select(F.col("episode").alias("env"), F.col("frame").alias("step"), F.col("value").alias("reward"), "done")
    return metrics.multi_step(steps, 5).withColumn("reward", F.round("reward", 4))


@query("""
z AS (SELECT episode, frame, list(k % 3) OVER w AS p, list(CASE WHEN k % 5 = 0 THEN -100 ELSE k % 3 END) OVER w AS l, length FROM ep WINDOW w AS (PARTITION BY episode ORDER BY frame ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
y AS (SELECT episode, frame, unnest(p[1:len(p) - 1]) AS p, unnest(l[2:len(l)]) AS l FROM z WHERE frame + 9 < length)
----SELECT episode, frame, round(avg(CASE WHEN p = l THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM y WHERE l <> -100 GROUP BY episode, frame
""", EVENTS)
def token_accuracy(spark, sf):
    df = events(spark, sf).withColumn("s", F.struct((F.col("k") % 3).alias("p"), F.when(F.col("k") % 5 == 0, -100).otherwise(F.col("k") % 3).alias("l")))
    df = windows.contiguous(df, "s", 10)
    out = df.select("episode", "frame", r6(metrics.token_accuracy(F.transform("chunk", lambda s: s["p"]), F.transform("chunk", lambda s: s["l"]))).alias("accuracy"))
    return out.where("accuracy is not null")


@query("""
SELECT vec_id, round(list_sum([(v[d] - (v[d + 8] - v[d + 16])) * (v[d] - (v[d + 8] - v[d + 16])) * (CASE WHEN d <= 5 THEN 1 ELSE 0 END) for d in range(1, 9)]) / (5 + 1e-6), 6) AS loss FROM em
""", EMBEDDINGS)
def masked_velocity_loss(spark, sf):
    s = lambda a, b: vectors.sliced(F.col("v"), a, b)
    mask = F.array(*[F.lit(1.0 if i < 5 else 0.0) for i in range(8)])
    return embeddings(spark, sf).select("vec_id", r6(metrics.masked_loss(s(0, 8), s(16, 24), s(8, 16), mask)).alias("loss"))


@query("""
s AS (SELECT event_id, 100 + event_id % 400 AS h, 80 + event_id % 570 AS w FROM events)
----SELECT event_id, CAST(greatest(floor(h * 0.9), 1) AS INTEGER) AS crop, CAST(floor((h - greatest(floor(h * 0.9), 1)) / 2) AS INTEGER) AS offset_y,
  CAST((greatest(h, w) - h) // 2 AS INTEGER) AS top, CAST(greatest(h, w) - h - (greatest(h, w) - h) // 2 AS INTEGER) AS bottom, CAST((greatest(h, w) - w) // 2 AS INTEGER) AS "left", CAST(greatest(h, w) - w - (greatest(h, w) - w) // 2 AS INTEGER) AS "right" FROM s
""")
def crop_geometry(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").select("event_id", (100 + F.col("event_id") % 400).alias("h"), (80 + F.col("event_id") % 570).alias("w"))
    top, bottom, left, right = geometry.letterbox(F.col("h"), F.col("w"))
    crop = geometry.crop_size(F.col("h"), 0.9)
    return df.select("event_id", crop.alias("crop"), geometry.centre_offset(F.col("h"), crop).alias("offset_y"), top.alias("top"), bottom.alias("bottom"), left.alias("left"), right.alias("right"))


# The other modules of queries register theirs.
from . import audits, datasets, endless, mixtures, processing  # noqa: E402, F401
