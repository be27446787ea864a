"""The episode sink publishes all or nothing; the schedule source goes on where it was."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kinetrace.operators import sharding
from kinetrace.sources import schedules, sinks
from kinetrace.sources.episodes import EpisodeSink


def frames(spark, episodes=7, n=30):
    return spark.range(episodes * n).selectExpr(f"cast(id % {episodes} as long) as episode_index", f"cast({n} - 1 - floor(id / {episodes}) as long) as frame_index", "array(cast(id as double)) as `observation.state`")


def listed(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))


def test_episode_files(spark, tmp_path):
    assert sinks.write_episode_files(frames(spark), f"file://{tmp_path}/d", chunks_size=3) == 7
    assert listed(tmp_path / "d") == [f"data/chunk-{e // 3:03d}/episode_{e:06d}.parquet" for e in range(7)]
    table = pq.read_table(tmp_path / "d/data/chunk-001/episode_000004.parquet", partitioning=None)
    assert table.column_names == ["episode_index", "frame_index", "observation.state"]
    assert table["frame_index"].to_pylist() == list(range(30)) and table["episode_index"].to_pylist() == [4] * 30
    with pytest.raises(Exception, match="holds data already"):
        sinks.write_episode_files(frames(spark), f"file://{tmp_path}/d")
    assert sinks.write_episode_files(frames(spark).limit(0), f"file://{tmp_path}/none") == 0


def test_long_episodes_have_several_row_groups(spark, tmp_path):
    sinks.write_episode_files(frames(spark, 2, 10_000), f"{tmp_path}/d")
    file = pq.ParquetFile(tmp_path / "d/data/chunk-000/episode_000001.parquet")
    assert file.num_row_groups >= 2 and file.read()["frame_index"].to_pylist() == list(range(10_000))


def test_a_job_that_fails_midway_leaves_nothing(spark, tmp_path):
    bad = frames(spark).withColumn("frame_index", F.when((F.col("episode_index") == 3) & (F.col("frame_index") == 17), F.raise_error(F.lit("no such frame")).cast("long")).otherwise(F.col("frame_index")))
    dealt = bad.repartitionByRange(4, "episode_index")
    spark.dataSource.register(EpisodeSink)
    with pytest.raises(Exception, match="no such frame"):
        dealt.write.format("trajectory_episodes").option("path", f"file://{tmp_path}/d").mode("append").save()
    assert listed(tmp_path / "d") == [] and not (tmp_path / "d/data").exists()


def test_episodes_of_two_tasks_are_refused(spark, tmp_path):
    spark.dataSource.register(EpisodeSink)
    with pytest.raises(Exception, match="two tasks"):
        frames(spark).repartition(3).sortWithinPartitions("episode_index").write.format("trajectory_episodes").option("path", f"{tmp_path}/d").mode("append").save()
    with pytest.raises(Exception, match="don't come together"):
        frames(spark).coalesce(1).write.format("trajectory_episodes").option("path", f"{tmp_path}/e").mode("append").save()
    assert listed(tmp_path) == []


DATASETS = [("a", 2.0, 10.0, 4), ("b", 1.0, 5.0, 3), ("c", 0.0, 5.0, 2), ("d", 5.0, 50.0, 11)]


def test_draws_are_those_of_the_batch_schedule(spark):
    table = spark.createDataFrame(DATASETS, "dataset string, weight double, mean_length double, shards long")
    want = sorted(map(tuple, sharding.schedule(table, 300, seed=4, epoch=3).collect()))
    assert list(schedules.draws(DATASETS, 7, 0, 300)) == want and list(schedules.draws(DATASETS, 7, 123, 300)) == want[123:]
    with pytest.raises(ValueError, match="weights"):
        list(schedules.draws([("a", 0.0, 1.0, 1)], 0, 0, 1))


def test_a_schedule_that_is_stopped_goes_on(spark, tmp_path):
    table = spark.createDataFrame(DATASETS, "dataset string, weight double, mean_length double, shards long")

    def run(name, batches, batch):
        for _ in range(batches):
            stream = schedules.endless(spark, table, f"file://{tmp_path}/{name}.json", draws_per_epoch=100, seed=9, batch=batch, partitions=2)
            stream.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-c").trigger(availableNow=True).start().awaitTermination(120)
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{name}").collect()))

    stopped, whole = run("stopped", 3, 80), run("whole", 1, 240)
    assert stopped == whole and len(whole) == 240
    assert [r[:2] for r in whole] == [(i // 100, i % 100) for i in range(240)]
    assert [r[1:] for r in whole if r[0] == 2] == list(schedules.draws(DATASETS, 11, 0, 40))


def test_a_task_names_its_folder_once(spark, tmp_path):
    """What a task sends to the driver is a folder and numbers, not a path a file."""
    import pyarrow as pa

    from kinetrace.sources.episodes import EpisodeWriter

    writer = EpisodeWriter({"path": f"{tmp_path}/d", "chunks_size": "2"}, ["episode_index", "frame_index"])
    made = [writer.write(iter([pa.record_batch([[e, e, e + 1], [0, 1, 0]], ["a", "b"])])) for e in (0, 2)]
    assert [m.episodes for m in made] == [[0, 1], [2, 3]] and made[0].folder != made[1].folder
    writer.commit([*made, None])
    assert listed(tmp_path) == [f"d/data/chunk-{e // 2:03d}/episode_{e:06d}.parquet" for e in range(4)]
