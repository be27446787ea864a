"""Blocks with halos, carried values and places, against the same work over whole episodes."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from kinetrace.operators import blocks, vectors, windows


@pytest.fixture(scope="module")
def episodes(spark):
    """Three episodes: a long one, one shorter than any block, and one of a single frame."""
    rng = random.Random(1)
    rows, t = [], 0.0
    for episode, n in ((1, 700), (2, 5), (3, 1)):
        t = 0.0
        for frame in range(n):
            t += rng.choice([0.0, 0.0, 0.1, 0.4, 3.0]) - rng.choice([0.0, 0.0, 0.2])
            rows.append((episode, frame, t, rng.choice([None, frame * 1.5])))
    return spark.createDataFrame(rows, "episode int, frame long, t double, x double").repartition(5)


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("offsets", [range(16), [-9, -4, -1, 0, 2, 7], [0, 3], [-2, 0], range(2, 18, 2), [-40, 0]])
@pytest.mark.parametrize("pad", [False, True])
def test_chunks_in_blocks_are_those_of_episodes(episodes, offsets, pad):
    whole = windows.chunked(episodes, "x", offsets, pad=pad)
    assert rows(windows.chunked(episodes, "x", offsets, pad=pad, block=32), "episode", "frame", "chunk") == rows(whole, "episode", "frame", "chunk")
    assert windows.chunked(episodes, "x", offsets, pad=pad, block=32).columns == whole.columns


def test_a_halo_holds_what_anchors_see_and_no_more(episodes):
    held = blocks.haloed(episodes.where("episode = 1"), -3, 5, 100).collect()
    for b in range(7):
        own = sorted(r.frame for r in held if r.block_ == b)
        assert own == list(range(max(0, 100 * b - 3), min(700, 100 * (b + 1) + 5)))
    assert sorted(r.frame for r in held if r.own_) == list(range(700))
    with pytest.raises(ValueError, match="sees itself"):
        blocks.haloed(episodes, 1, 5)


@pytest.mark.parametrize("start", [0.0, 7.5])
def test_resampling_in_blocks(episodes, start):
    got = windows.resampled(episodes, 0.5, start=start, block=16)
    assert rows(got, "episode", "frame", "grid", "grid_t") == rows(windows.resampled(episodes, 0.5, start=start), "episode", "frame", "grid", "grid_t")


def test_interpolation_in_blocks(spark, episodes):
    own = episodes.where("episode < 3").select("episode", "frame", "t", F.array(F.coalesce("x", F.lit(0.0))).alias("v"))
    ends = own.groupBy("episode").agg(F.first("t").alias("a"))
    ends = own.where("frame = 0").select("episode", F.col("t").alias("a")).join(own.groupBy("episode").agg(F.max("t").alias("b")), "episode")
    asked = ends.select("episode", F.explode(F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.col("a") + i / 60 * (F.col("b") - F.col("a")))).alias("at")).unionByName(own.groupBy("episode").agg(F.max("t").alias("at")))
    got, want = (sorted((r.episode, r.at, round(r.v[0], 9)) for r in windows.interpolated(own, asked, block=b).collect()) for b in (8, None))
    assert got == want and len(got) == 124
    late = spark.createDataFrame([(1, 1e9)], "episode int, at double")
    with pytest.raises(Exception, match="outside the samples"):
        windows.interpolated(own, late, block=8).collect()
    with pytest.raises(Exception, match="two samples"):
        windows.interpolated(episodes.where("episode = 3").select("episode", "frame", "t", F.array("t").alias("v")), episodes.where("episode = 3").select("episode", F.col("t").alias("at")), block=8).collect()


def test_no_task_has_an_episode(spark):
    one = spark.range(40_000).selectExpr("0 as episode", "id as frame", "id as x")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = windows.chunked(one, "x", range(16), block=64)
        sizes = [r["count"] for r in plan.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 40_000 - 15 and len(sizes) == 4 and max(sizes) <= 2 * median(sizes)


def test_carried_values(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 0, 1), ("a", 2, 9), ("a", 5, 2), (None, 1, 4), (None, 2, None)], "g string, block_ int, x int")
    got = blocks.carried(blocks.carried(df, {"m": (F.col("x"), F.max), "s": (F.col("x"), F.sum)}, ["g"]), {"n": (F.col("x"), F.min)}, ["g"], after=True)
    assert sorted({str(tuple(r)) for r in got.select("g", "block_", "m", "s", "n").collect()}) == sorted(map(str, [("a", 0, None, None, 2), ("a", 2, 5, 6, 2), ("a", 5, 9, 15, None), (None, 1, None, None, None), (None, 2, 4, 4, None)]))


def test_places_and_sums(spark):
    df = spark.range(3000).selectExpr("if(id < 2000, null, id % 2) as g", "5 - id % 6 as k", "id % 3 as n").repartition(7)
    out = blocks.placed(df, ["k"], ["g"], sums={"before": "n"}).collect()
    for g in (None, 0, 1):
        own = sorted((r for r in out if r.g == g), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own))) and [r.k for r in own] == sorted(r.k for r in own)
        total = 0
        for r in own:
            assert r.before == total
            total += r.n
    same = blocks.placed(spark.range(1000).selectExpr("1 as k"), ["k"])
    assert sorted(r.place for r in same.collect()) == list(range(1000)) and same.columns == ["k", "place"]
    assert blocks.placed(spark.range(0).selectExpr("id as k"), ["k"]).collect() == []


def test_reindexing_has_no_window_over_everything(spark, episodes):
    out = vectors.reindexed(episodes)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" in plan
    got = [(r.episode, r.frame, r.new_episode, r.new_frame, r.new_index) for r in out.orderBy("new_index").collect()]
    assert got == [(e, f, e - 1, f, i) for i, (e, f) in enumerate([(e, f) for e, n in ((1, 700), (2, 5), (3, 1)) for f in range(n)])]
