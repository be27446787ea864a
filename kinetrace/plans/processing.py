"""Queries of the processor, of statistics drivers, of metrics and of extensions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinetrace.functions import language as L
from kinetrace.operators import extensions, filters, geometry, images, merge, metrics, stats, vectors, windows
from kinetrace.operators.processor import Processor
from kinetrace.schema import ActionSpec, Kind, Layout, ModalitySpec, Representation

from .registry import each, nums, query, r6
from .views import EMBEDDINGS, EVENTS, embeddings, events

# -- the processor ---------------------------------------------------------------------------------------------------

_STEPS = 3
_MEAN, _STD = [[0.1 * t + 0.01 * d for d in range(4)] for t in range(_STEPS)], [[0.5 + 0.1 * t + 0.05 * d for d in range(4)] for t in range(_STEPS)]


def _flat(value: float, n: int) -> list[float]:
    return [value] * n


def _processor() -> Processor:
    """Joints relative to their state, a pose relative to the end effector's with scaled motion, and a gripper."""
    actions = (
        ActionSpec(Representation.RELATIVE, Kind.NON_EEF, Layout.DEFAULT, state_key="joints"),
        ActionSpec(Representation.REL_XYZ_ROT6D, Kind.EEF, Layout.XYZ_ROT6D, state_key="pose", rotation="quat", reference="quat", translation_scale_key="scale", rotation_scale_key="scale"),
        ActionSpec(normalization="minmax"),
    )
    specs = {"robot": {
        "state": ModalitySpec(("joints", "pose", "scale"), pass_through=frozenset({"pose", "scale"}), mean_std_keys=frozenset({"joints"})),
        "action": ModalitySpec(("joints", "pose", "gripper"), tuple(range(1, _STEPS + 1)), actions),
    }}
    every = lambda n, m, s: {"mean": m, "std": s, "min": _flat(-1.0, n), "max": _flat(2.0, n), "q01": _flat(-0.9, n), "q99": _flat(1.9, n)}
    joints = every(4, _MEAN, _STD)
    statistics = {"robot": {
        "state": {"joints": every(4, _flat(0.05, 4), _flat(0.2, 4)), "pose": every(7, _flat(0.0, 7), _flat(1.0, 7)), "scale": every(1, [0.0], [1.0])},
        "action": {"joints": every(4, _flat(9.0, 4), _flat(9.0, 4)), "pose": every(3, [0.01, 0.02, 0.03], [0.5, 0.25, 0.125]), "gripper": every(1, [0.0], [1.0])},
        "relative_action": {"joints": joints},
    }}
    return Processor(specs, statistics)


def _raw(spark, sf) -> DataFrame:
    df = embeddings(spark, sf)
    s = lambda a, b: vectors.sliced(F.col("v"), a, b)
    df = df.withColumn("row_", F.struct(s(20, 24).alias("j"), s(0, 7).alias("p"), s(30, 31).alias("g")))
    df = windows.chunked(df, "row_", range(1, _STEPS + 1))
    return df.select(
        "vec_id", s(20, 24).alias("state.joints"), s(0, 7).alias("state.pose"), F.array(F.lit(2.0)).alias("state.scale"),
        F.transform("chunk", lambda r: r["j"]).alias("action.joints"), F.transform("chunk", lambda r: r["p"]).alias("action.pose"), F.transform("chunk", lambda r: r["g"]).alias("action.gripper"),
    )


def _long(df: DataFrame, column: str) -> DataFrame:
    rows = df.select("vec_id", F.posexplode(F.col(f"`{column}`")).alias("t", "row"))
    return rows.select("vec_id", "t", F.posexplode("row").alias("i", "x")).withColumn("x", r6("x"))


_LATER = f"""
n AS (SELECT *, count(*) OVER (PARTITION BY episode) AS n FROM em),
c AS (SELECT a.vec_id, CAST(b.frame - a.frame - 1 AS INTEGER) AS t, a.v AS s, b.v AS v FROM n a JOIN n b ON b.episode = a.episode AND b.frame BETWEEN a.frame + 1 AND a.frame + {_STEPS} WHERE a.frame + {_STEPS} < a.n)
----"""


@query(_LATER + "SELECT vec_id, t, CAST(i AS INTEGER) AS i, round(greatest(least((v[21 + i] - s[21 + i] - (0.1 * t + 0.01 * i)) / (0.5 + 0.1 * t + 0.05 * i), 5.0), -5.0), 6) + 0.0 AS x FROM c, range(0, 4) k(i)", EMBEDDINGS)
def normalised_joints(spark, sf):
    return _long(_processor().apply(_raw(spark, sf), "robot"), "action.joints")


def _matrix(v: str) -> str:
    """SQL of the rotation matrix, row by row, of the quaternion that a vector holds behind its translation."""
    x, y, z, w = (f"({v}[{i}] / sqrt({v}[4] * {v}[4] + {v}[5] * {v}[5] + {v}[6] * {v}[6] + {v}[7] * {v}[7]))" for i in range(4, 8))
    return f"[1 - 2 * ({y} * {y} + {z} * {z}), 2 * ({x} * {y} - {z} * {w}), 2 * ({x} * {z} + {y} * {w}), 2 * ({x} * {y} + {z} * {w}), 1 - 2 * ({x} * {x} + {z} * {z}), 2 * ({y} * {z} - {x} * {w}), 2 * ({x} * {z} - {y} * {w}), 2 * ({y} * {z} + {x} * {w}), 1 - 2 * ({x} * {x} + {y} * {y})]"


def _product(a: str, b: str, turned: bool = False) -> str:
    """SQL of a product of matrices, the first of them transposed if asked for."""
    at = lambda i, k: 3 * k + i + 1 if turned else 3 * i + k + 1
    return "[" + ", ".join(" + ".join(f"{a}[{at(i, k)}] * {b}[{3 * k + j + 1}]" for k in range(3)) for i in range(3) for j in range(3)) + "]"


#: The rotation against the anchor's, its angle doubled by the motion's scale; its first two columns, which are not normalised.
_TURNED = _LATER.rpartition("----")[0].rstrip() + f""",
rt AS (SELECT vec_id, t, {_matrix("s")} AS a, {_matrix("v")} AS b FROM c),
rl AS (SELECT vec_id, t, {_product("a", "b", turned=True)} AS m FROM rt),
tw AS (SELECT vec_id, t, {_product("m", "m")} AS m FROM rl)
----"""


@query(_TURNED + """SELECT vec_id, t, CAST(i AS INTEGER) AS i, round(greatest(least(((v[1 + i] - s[1 + i]) * 2 - (i + 1) * 0.01) / [0.5, 0.25, 0.125][i + 1], 5.0), -5.0), 6) + 0.0 AS x FROM c, range(0, 3) k(i)
UNION ALL SELECT vec_id, t, CAST(3 + i AS INTEGER), round([m[1], m[4], m[7], m[2], m[5], m[8]][i + 1], 6) + 0.0 FROM tw, range(0, 6) k(i)""", EMBEDDINGS)
def normalised_poses(spark, sf):
    """Translations normalised, rotations as rot6d: all nine values of a relative pose."""
    return _long(_processor().apply(_raw(spark, sf), "robot"), "action.pose")


@query(_LATER + "SELECT vec_id, t, 0 AS i, round(2 * (v[31] + 1) / 3 - 1, 6) + 0.0 AS x FROM c", EMBEDDINGS)
def normalised_gripper(spark, sf):
    return _long(_processor().apply(_raw(spark, sf), "robot"), "action.gripper")


_UNCLIPPED = "WHERE abs(v[21 + i] - s[21 + i] - (0.1 * t + 0.01 * i)) < 5 * (0.5 + 0.1 * t + 0.05 * i)"


@query(_LATER + f"""SELECT vec_id, 'joints' AS key, t, CAST(i AS INTEGER) AS i, round(v[21 + i], 6) + 0.0 AS x FROM c, range(0, 4) k(i) {_UNCLIPPED}
UNION ALL SELECT vec_id, 'pose', t, CAST(i AS INTEGER), round(v[1 + i], 6) + 0.0 FROM c, range(0, 3) k(i) WHERE abs((v[1 + i] - s[1 + i]) * 2 - (i + 1) * 0.01) < 5 * [0.5, 0.25, 0.125][i + 1]
UNION ALL SELECT vec_id, 'gripper', t, 0, round(v[31], 6) + 0.0 FROM c""", EMBEDDINGS)
def processor_round_trip(spark, sf):
    """What is applied and undone is what was there, wherever no score was clipped; translations, of poses."""
    p, raw = _processor(), _raw(spark, sf)
    done = p.apply_action(raw, "robot")
    # Clipped scores stand at 5, which no other does here.
    scores = done.select("vec_id", *[F.col(f"`action.{k}`").alias(f"score.{k}") for k in ("joints", "pose", "gripper")])
    back = p.unapply_action(done, "robot")
    out = None
    for key in ("joints", "pose", "gripper"):
        own = _long(back, f"action.{key}").join(_long(scores, f"score.{key}").withColumnRenamed("x", "score"), ["vec_id", "t", "i"]).where(F.lit(key == "gripper") | (F.abs("score") < 5))
        own = own.select("vec_id", F.lit(key).alias("key"), "t", "i", "x")
        out = own if out is None else out.unionByName(own)
    return out.where("key <> 'pose' or i < 3")


@query(_LATER + """SELECT DISTINCT vec_id, CAST(i AS INTEGER) AS i, round(CASE WHEN i < 4 THEN greatest(least((s[21 + i] - 0.05) / 0.2, 5.0), -5.0) ELSE 0 END, 6) + 0.0 AS x FROM c, range(0, 6) k(i)""", EMBEDDINGS)
def joint_state_vector(spark, sf):
    p = _processor()
    return each(p.joint_vectors(p.apply(_raw(spark, sf), "robot"), "robot", 6, 16, 4), ["vec_id"], "state")


@query(_LATER + "SELECT DISTINCT vec_id, CAST(4 + 9 + 1 AS INTEGER) AS dims, CAST(3 AS INTEGER) AS steps, CAST(4 AS INTEGER) AS horizon, 16 AS width FROM c", EMBEDDINGS)
def joint_action_mask(spark, sf):
    p = _processor()
    df = p.joint_vectors(p.apply(_raw(spark, sf), "robot"), "robot", 6, 16, 4)
    ones = lambda row: F.aggregate(row, F.lit(0.0), lambda s, x: s + x)
    steps = F.size(F.filter("action_mask", lambda row: ones(row) > 0))
    return df.select("vec_id", ones(F.col("action_mask")[0]).cast("int").alias("dims"), steps.alias("steps"), F.size("action").alias("horizon"), F.size(F.col("action")[0]).alias("width"))


# -- statistics ------------------------------------------------------------------------------------------------------

_STATS = "round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) + 0.0 AS std, round(min(x), 6) + 0.0 AS min, round(max(x), 6) + 0.0 AS max"
_EIGHT = _STATS + ", " + ", ".join(f"round(quantile_cont(x, {p}), 6) + 0.0 AS {n}" for n, p in (("q01", 0.01), ("q02", 0.02), ("q98", 0.98), ("q99", 0.99)))
_SIX = _STATS + ", " + ", ".join(f"round(quantile_cont(x, {p}), 6) + 0.0 AS {n}" for n, p in (("q01", 0.01), ("q99", 0.99)))


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[r6(c).alias(c) for c in df.columns if c not in keys])


_AHEAD = """
n AS (SELECT *, count(*) OVER (PARTITION BY episode) AS n FROM em),
c AS (SELECT a.vec_id, CAST(b.frame - a.frame AS INTEGER) AS t, a.v AS s, b.v AS v FROM n a JOIN n b ON b.episode = a.episode AND b.frame BETWEEN a.frame AND a.frame + 3 WHERE a.frame + 3 < a.n),
"""


@query(_AHEAD + f"l AS (SELECT 'pose' AS key, t, CAST(i AS INTEGER) AS dim, (v[1 + i] - s[1 + i]) * s[9] AS x FROM c, range(0, 3) k(i))----SELECT key, t, dim, {_EIGHT} FROM l GROUP BY ALL", EMBEDDINGS)
def pose_temporal_stats(spark, sf):
    """Of poses relative to the anchor's, with motion scaled by a state: the translation's three dimensions."""
    df = embeddings(spark, sf).withColumn("p", vectors.sliced(F.col("v"), 0, 7)).withColumn("scale", vectors.sliced(F.col("v"), 8, 9))
    spec = ActionSpec(Representation.REL_XYZ_ROT6D, Kind.EEF, Layout.XYZ_ROT6D, rotation="quat", reference="quat")
    return _rounded(stats.pose_stats(df, "p", "p", range(4), spec, key="pose", scales=("scale", None)), "key", "t", "dim")


@query(_AHEAD + f"l AS (SELECT 'arm' AS key, t, CAST(i AS INTEGER) AS dim, v[21 + i] - s[21 + i] AS x FROM c, range(0, 4) k(i))----SELECT key, t, dim, {_SIX} FROM l GROUP BY ALL", EMBEDDINGS)
def relative_joint_stats(spark, sf):
    """The driver over declared actions: only the relative one has statistics."""
    s = vectors.sliced(F.col("v"), 20, 24)
    df = embeddings(spark, sf).withColumns({"action.arm": s, "state.arm": s, "action.hand": s})
    specs = {"arm": ActionSpec(Representation.RELATIVE), "hand": ActionSpec()}
    made = stats.relative_stats(df, specs, range(4))
    assert list(made) == ["arm"]
    return _rounded(made["arm"], "key", "t", "dim")


@query(f"""
l AS (SELECT 'embedding' AS feature, CAST(d - 1 AS INTEGER) AS dim, v[d] AS x FROM em, range(1, 9) k(d))
----SELECT feature, dim, {_SIX} FROM l GROUP BY ALL
""", EMBEDDINGS)
def counted_stats(spark, sf):
    """The one-pass form for small groups."""
    long = embeddings(spark, sf).select(F.lit("embedding").alias("feature"), F.posexplode(vectors.sliced(F.col("v"), 0, 8)).alias("dim", "value"))
    return _rounded(stats.summarised(long, ["feature", "dim"], "value", stats.FLAT, counted=True), "feature", "dim")


_PARTS = """
g AS (SELECT kind AS dataset, CAST(length(kind) AS DOUBLE) AS weight, value AS x FROM ep),
a AS (SELECT dataset, any_value(weight) AS w, min(x) AS x0, quantile_cont(x, 0.01) AS x1, quantile_cont(x, 0.02) AS x2, quantile_cont(x, 0.98) AS x3, quantile_cont(x, 0.99) AS x4, max(x) AS x5 FROM g GROUP BY dataset),
n AS (SELECT *, w / sum(w) OVER () AS u FROM a),
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
----SELECT CAST(row_number() OVER (ORDER BY p) - 1 AS INTEGER) AS i, round(v, 6) AS x FROM q
"""


@query(_PARTS, EVENTS)
def merge_quantiles_aggregate(spark, sf):
    """The grouped aggregate gives what the relational form gives."""
    own = stats.summarised(events(spark, sf).select(F.col("kind").alias("dataset"), "value"), ["dataset"], "value", stats.TEMPORAL).withColumn("weight", F.length("dataset").cast("double"))
    merged = extensions.merge_quantiles_aggregate()
    out = own.groupBy(F.lit("value").alias("key")).agg(merged(*[F.col(n) for n, _ in merge.KNOTS], F.col("weight")).alias("q"))
    return out.select(F.posexplode("q").alias("i", "x")).withColumn("x", r6("x"))


# -- filters, windows, metrics ---------------------------------------------------------------------------------------


@query("""
f AS (SELECT *, frame + 15 < length AND k > 20 AS keep FROM ep),
e AS (SELECT episode, count(*) AS n, count(*) FILTER (WHERE keep) AS k FROM f GROUP BY episode)
----SELECT CAST(count(*) AS BIGINT) AS episodes, CAST(sum(n) AS BIGINT) AS anchors, CAST(count(*) FILTER (WHERE k > 0) AS BIGINT) AS kept_episodes, CAST(sum(k) AS BIGINT) AS kept_anchors, CAST(count(*) FILTER (WHERE k = 0) AS BIGINT) AS dropped_episodes FROM e
""", EVENTS)
def filter_summary(spark, sf):
    df = events(spark, sf)
    return filters.filter_summary(df, filters.effective_anchors(df, range(16)).where("k > 20"))


@query("SELECT DISTINCT episode, least(greatest(frame + d, 0), length - 1) AS frame FROM ep, (SELECT unnest([-15, 0, 200]) AS d) o", EVENTS)
def clamped_frames(spark, sf):
    df = events(spark, sf)
    need = df.select("episode", F.explode(F.array(*[F.col("frame") + d for d in (-15, 0, 200)])).alias("frame"))
    return filters.check_frames(need, df.select("episode", "length").distinct(), clamp=True)


@query("SELECT episode, array_to_string(list_slice(list(k ORDER BY frame), greatest(len(list(k)) - 4, 1), len(list(k))), ',') AS last FROM ep GROUP BY episode", EVENTS)
def last_infos(spark, sf):
    held = extensions.lists_of(events(spark, sf), "episode", "frame", ["k"])
    return held.select("episode", nums(windows.last_n(F.col("k"), 5)).alias("last"))


@query("""
c AS (SELECT a.episode, a.frame, b.frame AS asked, b.value AS v, a.frame - b.frame AS i FROM ep a JOIN ep b ON b.episode = a.episode AND b.frame = a.frame - a.frame % 5)
----SELECT episode, frame, asked, round(v + i, 6) AS executed FROM c
""", EVENTS)
def closed_loop(spark, sf):
    """A chunk asked for at a frame holds that frame's value plus the step."""
    df = events(spark, sf).withColumn("chunk", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.col("value") + i))
    return windows.consumed(df, 5).select("episode", "frame", "asked", r6("executed").alias("executed"))


@query("""
p AS (SELECT a.episode, a.value - (b.value + (a.frame - b.frame)) AS d FROM ep a JOIN ep b ON b.episode = a.episode AND b.frame = a.frame - a.frame % 4)
----SELECT episode, round(avg(d * d), 6) AS mse, round(avg(abs(d)), 6) AS mae FROM p GROUP BY episode
""", EVENTS)
def chunked_open_loop(spark, sf):
    df = events(spark, sf).withColumn("truth", F.array("value"))
    chunks = df.select("episode", "frame", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.array(F.col("value") + i)).alias("chunk"))
    return metrics.chunk_errors(df, chunks, 4, "truth").select("episode", r6("mse").alias("mse"), r6("mae").alias("mae"))


@query("""
m AS (SELECT kind AS mode, median(k + 1) AS median, count(*) AS runs FROM ep GROUP BY kind)
----SELECT mode, round(median, 6) AS median, CAST(runs AS BIGINT) AS runs, round(1 / median, 6) AS hz, round((SELECT median FROM m WHERE mode = 'view') / median, 6) AS speed_up FROM m
""", EVENTS)
def latencies(spark, sf):
    df = events(spark, sf).select(F.col("kind").alias("mode"), (F.col("k") + 1.0).alias("seconds"))
    return _rounded(metrics.latencies(df, "view"), "mode", "runs")


@query("""
p AS (SELECT episode, value - k AS d, CAST(k AS DOUBLE) AS s FROM ep)
----SELECT episode, round(avg(d * d), 6) AS mse, round(avg(abs(d)), 6) AS mae, round(median(s), 6) AS median_seconds, round(sum(s), 6) AS total_seconds FROM p GROUP BY episode
""", EVENTS)
def open_loop_report(spark, sf):
    df = events(spark, sf).select("episode", F.array("value").alias("a"), F.array(F.col("k").cast("double")).alias("p"), F.col("k").cast("double").alias("s"))
    return _rounded(metrics.open_loop_report(df, "a", "p", "s"), "episode")


@query("""
w AS (SELECT i, CASE WHEN i < 4 THEN 0 ELSE (1 - exp(-3.0 * (i - 3) / 9)) / (1 - exp(-3.0)) END AS w FROM range(0, 12) r(i))
----SELECT a.episode, a.frame, CAST(i AS INTEGER) AS t, round((1 - w) * b.k + w * b.value, 6) + 0.0 AS x FROM ep a JOIN w ON true JOIN ep b ON b.episode = a.episode AND b.frame = a.frame + i WHERE a.frame + 11 < a.length
""", EVENTS)
def ramp_weights(spark, sf):
    """Chunks of one signal that go over into those of another along the ramp."""
    df = windows.contiguous(events(spark, sf).withColumn("pair", F.struct(F.col("k").cast("double").alias("old"), F.col("value").alias("new"))), "pair", 12)
    x = metrics.ramped(F.transform("chunk", lambda p: p["old"]), F.transform("chunk", lambda p: p["new"]), 4, 3.0, 12)
    return df.select("episode", "frame", F.posexplode(x).alias("t", "x")).withColumn("x", r6("x"))


@query("SELECT vec_id, CAST(t AS INTEGER) AS t, round(v[t * 2 + 1], 6) + 0.0 AS pan, round(v[t * 2 + 2], 6) + 0.0 AS lift FROM em, range(0, 3) k(t)", EMBEDDINGS)
def motor_commands(spark, sf):
    chunk = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda t: F.array(F.get(F.col("v"), t * 2), F.get(F.col("v"), t * 2 + 1)))
    out = extensions.commands(embeddings(spark, sf).withColumn("chunk", chunk), "chunk", ["pan", "lift"], "vec_id")
    return out.select("vec_id", "t", r6("pan").alias("pan"), r6("lift").alias("lift"))


@query("SELECT DISTINCT episode, frame + d AS frame FROM ep, (SELECT unnest([-15, 0, 2, 4, 8]) AS d) o WHERE frame + d >= 0", EVENTS)
def united_frames(spark, sf):
    """What a video's and an action's offsets ask for together."""
    return windows.required_frames(events(spark, sf), windows.union_offsets([-15, 0], [0, 2, 4, 8]))


@query("""
p AS (SELECT a.episode, a.frame, d, b.k FROM ep a, range(0, 8) o(d) JOIN ep b ON b.episode = a.episode AND b.frame = least(a.frame + d, a.length - 1) WHERE a.episode = (SELECT min(episode) FROM ep) AND a.frame >= 5)
----SELECT episode, frame, string_agg(k, ',' ORDER BY d) AS chunk FROM p GROUP BY episode, frame
""", EVENTS)
def replay_from(spark, sf):
    df = events(spark, sf)
    first = df.agg(F.min("episode")).first()[0]
    return windows.replay_from(df, "k", 8, first, 5).select("episode", "frame", nums(F.col("chunk")).alias("chunk"))


@query("""
s AS (SELECT episode AS env, frame, done, coalesce(sum(CAST(done AS INTEGER)) OVER (PARTITION BY episode ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM ep)
----SELECT env, frame AS step, CAST(row_number() OVER (PARTITION BY env ORDER BY frame) - 1 AS INTEGER) AS frame_number, CAST(row_number() OVER (PARTITION BY env, part ORDER BY frame) AS INTEGER) AS length FROM s
""", EVENTS)
def env_counters(spark, sf):
    return windows.counters(events(spark, sf).select(F.col("episode").alias("env"), F.col("frame").alias("step"), "done")).select("env", "step", "frame_number", "length")


@query("""
t AS (SELECT episode, list(DISTINCT kind ORDER BY kind) AS tasks FROM ep GROUP BY episode)
----SELECT episode, tasks[CAST(('0x' || substr(md5('9:' || episode), 1, 12)) AS BIGINT) % len(tasks) + 1] AS task FROM t
""", EVENTS)
def episode_task(spark, sf):
    tasks = events(spark, sf).groupBy("episode").agg(F.array_sort(F.collect_set("kind")).alias("tasks"))
    return tasks.select("episode", L.episode_task(F.col("tasks"), F.col("episode"), 9).alias("task"))


# -- extensions ------------------------------------------------------------------------------------------------------


@query("SELECT vec_id, round(2 * v[1] + v[2], 6) + 0.0 AS act FROM em", EMBEDDINGS)
def policy_hook(spark, sf):
    def make():
        return lambda batch: {"act": [2 * x[0] + x[1] for x in batch["v"]]}

    df = embeddings(spark, sf).select("vec_id", "v")
    return extensions.with_policy(df, make, "act double", {"v": ("array<double>", 64)}).select("vec_id", r6("act").alias("act"))


@query("""
g AS (SELECT *, CAST(floor(t / 7200 + 1e-5) AS BIGINT) AS gi FROM ep),
n AS (SELECT *, greatest(coalesce(max(gi) OVER (PARTITION BY episode ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), -1) + 1 AS free FROM g)
----SELECT episode, frame, unnest(generate_series(free, gi)) AS grid FROM n WHERE gi >= free
""", EVENTS)
def resample_function(spark, sf):
    """The table function over each episode's times."""
    extensions.register_functions(spark)
    held = extensions.lists_of(events(spark, sf), "episode", "frame", ["t"])
    held.createOrReplaceTempView("kinetrace_times")
    return spark.sql("SELECT episode, CAST(sample AS BIGINT) AS frame, grid FROM kinetrace_times, LATERAL resample(t, 7200D, 0D)")


# -- images ----------------------------------------------------------------------------------------------------------

_IMAGES = """
s AS (SELECT event_id, 4 + event_id % 5 AS h, 3 + event_id % 7 AS w FROM events),
p AS (SELECT event_id, h, w, y, x, sum((event_id + 7 * y + 3 * x + c) % 256) AS v FROM s, range(0, 8) a(y), range(0, 9) b(x), range(0, 3) d(c) WHERE y < h AND x < w GROUP BY ALL)
----"""


def _made(batches):
    """Of event ids, pictures of one shape at a time."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        heights, widths = 4 + ids % 5, 3 + ids % 7
        for h, w in sorted(set(zip(heights.tolist(), widths.tolist(), strict=True))):
            own = ids[(heights == h) & (widths == w)]
            y, x, c = np.indices((h, w, 3))
            pixels = ((own[:, None] + (7 * y + 3 * x + c).ravel()) % 256).astype(np.uint8)
            mask = (x[..., 0] % 2 == 0).astype(np.uint8).tobytes()
            n = len(own)
            columns = [pa.array(["made"] * n), pa.array(own), pa.array(np.full(n, h, np.int32)), pa.array(np.full(n, w, np.int32)), pa.array([p.tobytes() for p in pixels], pa.binary()), pa.array([mask] * n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "frame", "height", "width", "image", "mask"])


def _images(spark, sf) -> DataFrame:
    """A small picture for each event, its pixels given by place and id; the mask has 1 in even columns."""
    df = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").cast("long"))
    # Ids are a few bytes each and pictures are not, so the file's splits say nothing about the work.
    df = df.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return df.mapInArrow(_made, "path string, frame long, height int, width int, image binary, mask binary")


def _sums(df: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(images.byte_sums(batch.column(3)))], names=["event_id", "height", "width", "total"])

    return df.select("frame", "height", "width", "image").mapInArrow(run, "event_id long, height int, width int, total long")


_CROPPED = _IMAGES.replace("----", ",\nq AS (SELECT *, CAST(greatest(floor(h * 0.6), 1) AS INTEGER) AS ch, CAST(greatest(floor(w * 0.6), 1) AS INTEGER) AS cw FROM p),\no AS (SELECT *, CAST(floor((h - ch) / 2) AS INTEGER) AS oy, CAST(floor((w - cw) / 2) AS INTEGER) AS ox FROM q)\n----")


@query(_CROPPED + "SELECT event_id, any_value(ch) AS height, any_value(cw) AS width, CAST(sum(v) AS BIGINT) AS total FROM o WHERE y >= oy AND y < oy + ch AND x >= ox AND x < ox + cw GROUP BY event_id")
def centre_crop_pixels(spark, sf):
    return _sums(images.transformed(_images(spark, sf), images.centre_crop(0.6)))


@query(_IMAGES + "SELECT event_id, CAST(greatest(any_value(h), any_value(w)) AS INTEGER) AS height, CAST(greatest(any_value(h), any_value(w)) AS INTEGER) AS width, CAST(sum(v) AS BIGINT) AS total FROM p GROUP BY event_id")
def letterbox_pixels(spark, sf):
    return _sums(images.transformed(_images(spark, sf), images.letterbox()))


@query(_IMAGES + "SELECT event_id, CAST(any_value(h) AS INTEGER) AS height, CAST(any_value(w) AS INTEGER) AS width, CAST(coalesce(sum(v) FILTER (WHERE x % 2 = 0), 0) AS BIGINT) AS total FROM p GROUP BY event_id")
def masked_noise_pixels(spark, sf):
    """Noise over the background leaves the pixels that the mask names; those are summed."""
    noisy = images.transformed(_images(spark, sf), images.background_noise([0]))
    kept = images.transformed(noisy, lambda image, mask, _: (image * mask[..., None], mask))
    return _sums(kept)


@query(_IMAGES + "SELECT event_id, CAST(any_value(h) AS INTEGER) AS height, CAST(any_value(w) AS INTEGER) AS width, CAST(coalesce(sum(v) FILTER (WHERE x % 2 = 1), 0) AS BIGINT) AS total FROM p GROUP BY event_id")
def tinted_pixels(spark, sf):
    """A colour over the pixels that the mask names leaves the background; that is summed."""
    tinted = images.transformed(_images(spark, sf), images.mask_tint([1], p=1.0))
    kept = images.transformed(tinted, lambda image, mask, _: (image * (mask == 0)[..., None], mask))
    return _sums(kept)


@query(_CROPPED + "SELECT event_id, any_value(ch) AS height, any_value(cw) AS width, CAST(2 AS BIGINT) AS views, true AS alike FROM o GROUP BY event_id")
def views_drawn_alike(spark, sf):
    """Two views of a step, whose second has other pixels, are cropped at the same place: their difference stays what it was."""
    one = _images(spark, sf)
    two = images.transformed(one, lambda image, mask, _: (image ^ 255, mask)).withColumn("path", F.lit("other"))
    both = images.transformed(one.unionByName(two), images.random_crop(0.6))
    # Both views of a step meet in one shuffle, each drawn once.
    view = lambda p: F.first(F.when(F.col("path") == p, F.struct("height", "width", "image")), ignorenulls=True)
    met = both.groupBy("frame").agg(view("made").alias("a"), view("other").alias("b"), F.count("*").alias("views"))
    inverse = bytes(255 - i for i in range(256))

    def run(batches):
        for batch in batches:
            alike = [x.translate(inverse) == y for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(alike, pa.bool_())], names=["event_id", "height", "width", "views", "alike"])

    out = met.where("a is not null and b is not null").select("frame", F.col("a.height"), F.col("a.width"), "views", F.col("a.image").alias("one"), F.col("b.image").alias("other"))
    return out.mapInArrow(run, "event_id long, height int, width int, views long, alike boolean")


@query(_IMAGES + "SELECT event_id, CAST(20 AS INTEGER) AS height, CAST(24 AS INTEGER) AS width, CAST(sum(v) AS BIGINT) AS total FROM p GROUP BY event_id")
def padded_pixels(spark, sf):
    """Scaled to fit and padded: of images padded to a square of 20 first, only the padding grows."""
    square = images.transformed(_images(spark, sf), lambda image, mask, _: (images.padded(image, 20, 20), None))
    return _sums(images.transformed(square, images.resize_pad(20, 24)))


@query("SELECT event_id, CAST(48 AS INTEGER) AS height, CAST(floor(round((80 + event_id % 570) * 49.0 / (100 + event_id % 400), 0) / 2) * 2 AS INTEGER) AS width FROM events")
def recorded_sizes(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").select("event_id", (100 + F.col("event_id") % 400).alias("h"), (80 + F.col("event_id") % 570).alias("w"))
    h, w = geometry.recorded_size(F.col("h"), F.col("w"), 49)
    return df.select("event_id", h.alias("height"), w.alias("width"))
