"""Streams of frames: the same as over tables, and state that ends."""

import datetime as dt
import random
import uuid

import numpy as np
import pytest

from kinetrace.streaming import frames as streams

EPOCH = dt.datetime(2024, 1, 1)


def at(seconds):
    return EPOCH + dt.timedelta(seconds=seconds)


class Feed:
    """A stream over files that are added one by one; each is run to its end, with what the watermark then ends."""

    def __init__(self, spark, tmp_path, schema, make):
        self.spark, self.schema, self.name = spark, schema, f"t{uuid.uuid4().hex[:8]}"
        self.src, self.check, self.make = f"{tmp_path}/{self.name}", f"{tmp_path}/c{self.name}", make
        (tmp_path / self.name).mkdir()

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.src)
        stream = self.make(self.spark.readStream.schema(self.schema).parquet(self.src))
        query = stream.writeStream.format("parquet").option("path", f"{self.src}-out").option("checkpointLocation", self.check).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        self.state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        return sorted(map(tuple, self.spark.read.schema(stream.schema).parquet(f"{self.src}-out").collect()), key=str)


def test_resampling_ends_with_silence(spark, tmp_path):
    feed = Feed(spark, tmp_path, "episode long, frame long, t double, ts timestamp", lambda s: streams.resample_stream(s, 0.1, late="10 seconds", idle="1 minute"))
    feed.add([(0, j, 0.2 * j, at(j)) for j in range(3)])
    got = feed.add([(0, j, 0.2 * j, at(j)) for j in range(3, 6)])
    assert sorted(r[3] for r in got) == list(range(11)) and feed.state == 1
    feed.add([(1, 0, 0.0, at(100))])  # the watermark is at 90 s: episode 0 has ended
    assert feed.state == 1
    got = feed.add([(0, 6, 1.2, at(50)), (1, 1, 0.1, at(101))])  # late for the watermark: dropped
    assert not [r for r in got if r[0] == 0 and r[1] == 6] and [r[3] for r in got if r[0] == 1] == [0, 1]
    got = feed.add([(0, 7, 300.0, at(300))])  # goes on after its end: nothing is filled in between
    assert [r[3] for r in got if r[0] == 0 and r[1] == 7] == [3000]


def test_rollouts_are_cut_by_silence(spark, tmp_path):
    schema = "env long, step long, reward double, success boolean, done boolean, ts timestamp"
    feed = Feed(spark, tmp_path, schema, lambda s: streams.rollout_stream(s, late="10 seconds", idle="1 minute"))
    got = feed.add([(0, i, 1.0, i == 1, i == 2, at(i)) for i in range(4)])
    assert got == [(0, 0, 3, 3.0, True, False)]
    got = feed.add([(0, 4, 1.0, False, False, at(200)), (1, 0, 1.0, True, False, at(200))])  # a later step tells of the silence
    assert (0, 1, 1, 1.0, False, True) in got and len(got) == 2
    got = feed.add([(2, 0, 1.0, True, True, at(500))])  # only the watermark tells
    assert (0, 0, 1, 1.0, False, True) in got and (1, 0, 1, 1.0, True, True) in got and (2, 0, 1, 1.0, True, False) in got and len(got) == 5
    assert feed.state == 1


def test_rollouts_of_one_batch_equal_a_loop(spark, tmp_path):
    rng = random.Random(2)
    rows, now = [], 0.0
    for i in range(300):
        now += rng.choice([1.0, 1.0, 30.0, 60.0, 61.0])
        rows.append((0, i, 1.0, rng.random() < 0.2, rng.random() < 0.2, at(now)))
    want, n, length, win, last = [], 0, 0, False, None
    for _, _, _, success, done, ts in rows:
        if last is not None and (ts - last).total_seconds() > 60:
            if length:
                want.append((0, n, length, float(length), win, True))
            n, length, win = 0, 0, False
        length, win, last = length + 1, win or success, ts
        if done:
            want.append((0, n, length, float(length), win, False))
            n, length, win = n + 1, 0, False
    schema = "env long, step long, reward double, success boolean, done boolean, ts timestamp"
    feed = Feed(spark, tmp_path, schema, lambda s: streams.rollout_stream(s, late="1 day", idle="1 minute"))
    feed.add(rows[:111])
    assert feed.add(rows[111:]) == sorted(want, key=str)


def test_segments_of_a_stream_are_those_of_the_table(spark, tmp_path):
    rng = random.Random(3)
    rows, now = [], 0.0
    for i in range(240):
        now += rng.choice([0.0, 1.0, 9.9999, 10.0, 10.0005, 25.0])
        rows.append((i % 3, i, at(now)))
    feed = Feed(spark, tmp_path, "device long, row long, ts timestamp", lambda s: streams.segment_stream(s, "10 seconds", late="20 seconds"))
    for a, b in ((0, 70), (70, 71), (71, 180), (180, 240)):
        got = feed.add(rows[a:b])
    table = spark.createDataFrame(rows, "device long, row long, ts timestamp")
    want = streams.segmented(table, "10 seconds", order=["row"]).select("device", "row", "start", "frame").collect()
    assert got == sorted(map(tuple, want), key=str)
    whole = sorted((r.device, r.start, r.length) for r in streams.episode_windows(table, "10 seconds").collect())
    assert whole == sorted((d, s, sum(1 for r in want if (r.device, r.start) == (d, s))) for d, s in {(r.device, r.start) for r in want})


def test_session_windows_of_a_stream(spark, tmp_path):
    feed = Feed(spark, tmp_path, "device long, row long, ts timestamp", lambda s: streams.episode_windows(s, "10 seconds", late="5 seconds"))
    feed.add([(1, 0, at(0)), (1, 1, at(5))])
    got = feed.add([(1, 2, at(100))])
    assert got == [(1, at(0), at(5), 2)] and feed.state == 1


@pytest.mark.parametrize("free", [0, 3])
def test_grid_places_of_nothing(free):
    sample, grid, after = streams.grid_places(np.zeros(0), 1.0, 0.0, free)
    assert len(sample) == len(grid) == 0 and after == free


def test_what_a_stream_gives_stays_off_the_driver(spark, tmp_path):
    spark.createDataFrame([(i % 3, i, at(i)) for i in range(30)], "device long, row long, ts timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("device long, row long, ts timestamp").parquet(f"{tmp_path}/in")
    out = streams.drained(streams.segment_stream(stream, "10 seconds"), f"d{uuid.uuid4().hex[:8]}")
    assert len(out.inputFiles()) > 0 and out.count() == 30  # files that executors wrote, not a table in the driver's memory


def test_a_slice_of_a_stream_is_a_trigger_of_several_files(spark, monkeypatch):
    from pyspark.sql import functions as F

    from kinetrace.plans import datasets

    monkeypatch.setattr(datasets, "FILE_ROWS", 30)
    df = spark.range(0, 300, 1, 4).select((F.col("id") % 7).alias("device"), F.col("id").alias("row"), F.timestamp_seconds(F.col("id") * 5).alias("ts"))
    seen = []

    def note(batch, i):
        seen.append((batch.agg(F.min("row"), F.max("row"), F.count("*")).first(), batch.select(F.input_file_name()).distinct().count()))

    query = datasets._stream(spark, df, 3).writeStream.foreachBatch(note).option("checkpointLocation", f"{datasets.shared_folder(spark)}/t{uuid.uuid4().hex}").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(tuple(a), n) for a, n in seen] == [((0, 99, 100), 3), ((100, 199, 100), 3), ((200, 299, 100), 3)]
