"""Queries over one episode that holds all events: no task may be handed an episode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.operators import blocks, windows

from .registry import nums, query, r6

#: Frames of a block here; small, so that small tables have cuts as well.
SIZE = 512

TIMELINE = """
tl AS (SELECT 0 AS episode, row_number() OVER w - 1 AS frame, event_id, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1e6 AS t, value, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k
  FROM events WINDOW w AS (ORDER BY ts, event_id))"""


def timeline(spark, sf) -> DataFrame:
    """All events as one episode, 0: frame, event_id, t (seconds), value, k."""
    df = spark.read.parquet(f"{sf}/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    start = df.agg(F.min(micros)).first()[0]
    own = df.select("event_id", "ts", ((micros - F.lit(start)) / 1e6).alias("t"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return blocks.placed(own, ["ts", "event_id"], name="frame").drop("ts").withColumn("episode", F.lit(0))


@query("SELECT event_id, frame FROM tl", TIMELINE)
def endless_places(spark, sf):
    return timeline(spark, sf).select("event_id", "frame")


@query("""
c AS (SELECT frame, list(k) OVER (ORDER BY frame ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS c FROM tl)
----SELECT frame, array_to_string(c, ',') AS chunk FROM c WHERE len(c) = 16
""", TIMELINE)
def endless_chunks(spark, sf):
    return windows.chunked(timeline(spark, sf), "k", range(16), block=SIZE).select("frame", nums(F.col("chunk")).alias("chunk"))


@query("""
n AS (SELECT max(frame) AS last FROM tl),
p AS (SELECT a.frame, d, b.k FROM tl a, n, (SELECT unnest([-9, -4, -1, 0, 2, 7]) AS d) o JOIN tl b ON b.frame = least(greatest(a.frame + d, 0), last))
----SELECT frame, string_agg(k, ',' ORDER BY d) AS chunk FROM p GROUP BY frame
""", TIMELINE)
def endless_padded(spark, sf):
    return windows.chunked(timeline(spark, sf), "k", [-9, -4, -1, 0, 2, 7], pad=True, block=SIZE).select("frame", nums(F.col("chunk")).alias("chunk"))


@query("""
g AS (SELECT *, CAST(floor(t / 60 + 1e-5) AS BIGINT) AS gi FROM tl),
n AS (SELECT *, greatest(coalesce(max(gi) OVER (ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), -1) + 1 AS free FROM g)
----SELECT frame, unnest(generate_series(free, gi)) AS grid FROM n WHERE gi >= free
""", TIMELINE)
def endless_resample(spark, sf):
    return windows.resampled(timeline(spark, sf), 60.0, block=SIZE).select("frame", "grid")


@query("""
q AS (SELECT DISTINCT floor(t / 100) * 100 AS "at" FROM tl),
d AS (SELECT * FROM (SELECT t, value, max(t) OVER (ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM tl) WHERE top IS NULL OR t > top),
l AS (SELECT "at", t AS t0, value AS v0 FROM q ASOF JOIN d ON "at" >= t),
u AS (SELECT "at", t AS t1, value AS v1 FROM q ASOF JOIN d ON "at" <= t)
----SELECT round("at", 3) AS "at", round(CASE WHEN t1 > t0 THEN v0 + ("at" - t0) / (t1 - t0) * (v1 - v0) ELSE v0 END, 6) AS v FROM l JOIN u USING ("at")
""", TIMELINE)
def endless_interpolation(spark, sf):
    df = timeline(spark, sf)
    asked = df.select("episode", (F.floor(F.col("t") / 100) * 100).cast("double").alias("at")).distinct()
    out = windows.interpolated(df.select("episode", "frame", "t", F.array("value").alias("v")), asked, block=SIZE)
    return out.select(F.round("at", 3).alias("at"), r6(F.col("v")[0]).alias("v"))
