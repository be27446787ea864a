"""Dataset directories: what a sparse load opens, and which anchors a factory keeps."""

from types import SimpleNamespace

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kinetrace.operators.filters import AnchorRule, clutch_filter, terminal_filter
from kinetrace.schema import RAW_ENGAGED, RAW_LINKED
from kinetrace.sources import lerobot, sinks

INFO = {"chunks_size": 2, "data_path": "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet", "features": {}}


@pytest.fixture
def dataset(spark, tmp_path):
    frames = spark.createDataFrame([(e, f, [float(f), float(e)], f % 3) for e in range(5) for f in range(40)], "episode_index long, frame_index long, `observation.state` array<double>, task_index long")
    episodes = spark.createDataFrame([(e, ["go"], 40) for e in range(5)], "episode_index long, tasks array<string>, length long")
    sinks.write_dataset(frames, episodes, spark.createDataFrame([(0, "go")], "task_index long, task string"), INFO, {}, f"file://{tmp_path}/d")
    return lerobot.TrajectoryDataset(spark, f"file://{tmp_path}/d")


def test_sparse_load_opens_only_what_is_asked_for(spark, dataset, tmp_path):
    for e in (0, 2, 4):  # whoever opens these finds no Parquet, but for the one whose schema is read
        if e:
            (tmp_path / f"d/data/chunk-{e // 2:03d}/episode_{e:06d}.parquet").write_bytes(b"no Parquet")
    need = spark.createDataFrame([(1, 5), (1, 5), (3, 39), (3, 0)], "episode_index long, frame_index long")
    got = sorted((r.episode_index, r.frame_index, r["observation.state"], r.length) for r in dataset.sparse(need).collect())
    assert got == [(1, 5, [5.0, 1.0], 40), (3, 0, [0.0, 3.0], 40), (3, 39, [39.0, 3.0], 40)]
    assert dataset.sparse(need, columns=["task_index"]).columns[:3] == ["episode_index", "frame_index", "task_index"]
    with pytest.raises(Exception, match="no Parquet|Parquet magic"):
        dataset.sparse(spark.createDataFrame([(2, 5)], need.schema)).collect()
    with pytest.raises(Exception, match="frame 40 is missing in episode 1"):
        dataset.sparse(spark.createDataFrame([(1, 40)], need.schema)).collect()
    pq.write_table(pa.table({"episode_index": [1], "frame_index": [0], "observation.state": [[0.0]], "task_index": [0]}), f"{tmp_path}/d/data/chunk-000/episode_000001.parquet")
    with pytest.raises(Exception, match="lacks the frames .5."):
        dataset.sparse(need).collect()


def test_sparse_load_clamps_and_reads_shards(spark, dataset):
    need = "episode_index long, frame_index long"
    clamped = dataset.sparse(spark.createDataFrame([(1, 40), (1, -7), (1, 39)], need), clamp=True)
    assert sorted(r.frame_index for r in clamped.collect()) == [0, 39]
    plan = spark.createDataFrame([(1, 0, 7), (3, 38, 7), (2, 0, 8)], "episode long, frame long, shard int")
    assert sorted((r.episode_index, r.frame_index) for r in dataset.shard_frames(plan, 7, [0, 3]).collect()) == [(1, 0), (1, 3), (3, 38), (3, 39)]


def test_row_groups_without_wanted_frames_are_left_out(tmp_path):
    path = f"{tmp_path}/x.parquet"
    pq.write_table(pa.table({"frame_index": list(range(100)), "v": [[1.0]] * 100}), path, row_group_size=10)
    metadata = pq.ParquetFile(path).metadata
    assert lerobot.overlapping(metadata, [5, 9, 31, 99]) == [0, 3, 9] and lerobot.overlapping(metadata, [200]) == []
    pq.write_table(pa.table({"frame_index": list(range(20))}), path, row_group_size=10, write_statistics=False)
    assert lerobot.overlapping(pq.ParquetFile(path).metadata, [1]) == [0, 1]


def test_rules_are_chosen_from_declarations():
    keys = {"hapticengaged_left": {}, "hapticengaged_right": {}}
    made = lambda modality, features, tag: AnchorRule.of(SimpleNamespace(modality=modality, info={"features": features}), tag, (0, 1)).kind
    assert made({"state": keys}, {"next.done": {}}, "ucsd_dvrk") == "clutch"
    assert made({"state": {"hapticengaged_left": {}}, "action": {"hapticengaged_right": {}}}, {}, "x") == "clutch"
    assert made({}, {"next.done": {}}, "ucsd_dvrk") == "terminal" and made({}, {"next.done": {}}, "ucb_dvrk") is None and made({}, {}, "ucsd_dvrk") is None


@pytest.mark.parametrize("offsets", [(0, 1, 2), (2, 4, 6, 8, 10), (0,)])
def test_rules_mark_what_filters_keep(spark, offsets):
    df = spark.range(300).selectExpr("id % 4 as episode", "cast(floor(id / 4) as long) as frame", "xxhash64(id) % 11 = 0 as on", "floor(id / 40) as link", "xxhash64(id, 1) % 60 = 0 as done", "70L as length")
    raw = [F.lit(0.0)] * 22
    raw[RAW_ENGAGED["right"]], raw[RAW_LINKED["left"]] = F.col("on").cast("double"), F.col("link").cast("double")
    df = df.withColumns({"observation.state": F.array(*raw), "next.done": F.col("done")})
    kept = lambda kind: sorted((r.episode, r.frame) for r in AnchorRule(kind, offsets).marked(df, length="length").where("anchor").collect())
    rows = lambda out: sorted((r.episode, r.frame) for r in out.where(F.col("frame") + max(offsets) < 70).collect())
    assert kept("clutch") == rows(clutch_filter(df, offsets, links=["link"], engaged=["on"]))
    assert kept("terminal") == rows(terminal_filter(df, offsets))
    assert kept(None) == rows(df)


def test_files_of_a_dataset_are_listed_once(spark, monkeypatch):
    from pyspark.sql import DataFrameReader
    from pyspark.sql import functions as F

    from kinetrace.operators import stats
    from kinetrace.sources import lerobot, sinks
    from kinetrace.sources.storage import shared_folder

    root = f"{shared_folder(spark)}/listed-once-{id(monkeypatch)}"
    frames = spark.range(40).select(F.array(F.col("id").cast("double")).alias("action"), (F.col("id") % 10).alias("frame_index"), F.floor(F.col("id") / 10).alias("episode_index"), F.lit(0).cast("long").alias("task_index"))
    episodes = frames.groupBy("episode_index").agg(F.array(F.lit("go")).alias("tasks"), F.count("*").alias("length"))
    info = {"chunks_size": 2, "data_path": "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet", "features": {"action": {"dtype": "float64", "shape": [1]}}}
    sinks.write_dataset(frames, episodes, spark.createDataFrame([(0, "go")], "task_index long, task string"), info, {"action": {"arm": {"start": 0, "end": 1}}}, root)
    listed, real = [], DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *p, **o: listed.extend(x for x in p if "/data/*" in x) or real(self, *p, **o))
    data = lerobot.TrajectoryDataset(spark, root)
    assert stats.ensure_stats(data, {}, range(2)) == ["stats.json"]
    again = data.reread(need_stats=True)
    assert stats.ensure_stats(again, {}, range(2)) == [] and again.load().count() == 40 and len(listed) == 1


def test_frames_are_listed_and_read_by_tasks(spark, dataset, tmp_path):
    from kinetrace.operators import stats

    frames = dataset.frames()
    assert frames.inputFiles() == []  # an entry a file in the plan, and at the driver, before
    assert stats.estimated_bytes(frames) > 1 << 40  # so no join broadcasts them
    assert sorted((r.episode_index, r.frame_index, r["observation.state"], r.task_index) for r in frames.collect()) == [(e, f, [float(f), float(e)], f % 3) for e in range(5) for f in range(40)]
    assert dataset.frames(columns=["task_index"]).columns == ["episode_index", "frame_index", "task_index"]
    assert dataset.frames([3], columns=[]).columns == ["episode_index", "frame_index"] and dataset.frames([3], columns=[]).count() == 40
    folder = tmp_path / "d/data/chunk-002"
    for hidden in ("_episode_000009.parquet", ".episode_000009.parquet", "notes.txt"):
        (folder / hidden).write_bytes(b"no Parquet")
    (tmp_path / "d/data/chunk-003").mkdir()
    pq.write_table(pa.table({"frame_index": pa.array([0], pa.int32()), "task_index": [7]}), folder / "episode_000005.parquet")
    assert sorted(map(tuple, dataset.frames().where("episode_index > 4").collect())) == [(5, 0, None, 7)]


def test_an_episode_is_named_by_its_file_where_frames_lack_it(spark, tmp_path):
    for e in range(3):
        folder = tmp_path / f"d/data/chunk-{e // 2:03d}"
        folder.mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.table({"frame_index": [0, 1], "action": [[1.0 * e], [2.0 * e]]}), folder / f"episode_{e:06d}.parquet")
    sinks.write_json(spark, INFO, f"file://{tmp_path}/d/meta/info.json")
    data = lerobot.TrajectoryDataset(spark, f"file://{tmp_path}/d")
    got = data.frames().select("episode_index", "frame_index", "action").collect()
    assert sorted(map(tuple, got)) == [(e, f, [e * (f + 1.0)]) for e in range(3) for f in range(2)]
    (tmp_path / "none/data").mkdir(parents=True)
    sinks.write_json(spark, INFO, f"file://{tmp_path}/none/meta/info.json")
    with pytest.raises(FileNotFoundError, match="no frames"):
        lerobot.TrajectoryDataset(spark, f"file://{tmp_path}/none").frames()


def test_stores_that_only_spark_opens_are_listed_by_folders(spark, dataset, monkeypatch):
    def unknown(path):
        raise pa.ArrowInvalid("Unrecognized filesystem type in URI")

    want = sorted(map(str, dataset.frames(columns=["task_index"]).collect()))
    monkeypatch.setattr(lerobot, "filesystem", unknown)
    df = dataset.frames(columns=["task_index"])
    assert len(df.inputFiles()) == 5 and sorted(map(str, df.collect())) == want


def test_frames_of_short_episodes_go_on_together():
    schema = pa.schema([("c0", pa.int64())])
    tables = [pa.table({"c0": pa.array([i] * 3, pa.int64())}, schema) for i in range(2000)]
    batches = list(lerobot._together(iter(tables)))  # a batch an episode before
    assert len(batches) < 10 and pa.Table.from_batches(batches)["c0"].to_pylist() == [i for i in range(2000) for _ in range(3)]
    assert list(lerobot._together(iter([]))) == []
    wide = [pa.table({"c0": pa.array(range(3_000_000), pa.int64())}, schema)] * 2
    assert sum(b.num_rows for b in lerobot._together(iter(wide))) == 6_000_000


def test_statistics_read_the_columns_that_they_need(spark, dataset, monkeypatch):
    from kinetrace.operators import stats

    asked, real = [], lerobot.TrajectoryDataset.frames
    monkeypatch.setattr(lerobot.TrajectoryDataset, "frames", lambda self, episodes=None, columns=None: asked.append(columns) or real(self, episodes, columns))
    dataset.info["features"] = {"observation.state": {"dtype": "float64", "shape": [2]}, "task_index": {"dtype": "int64", "shape": [1]}}
    made = stats.dataset_stats(dataset)
    assert asked[-1] == ["observation.state"] and made["observation.state"]["mean"] == [19.5, 2.0] and made["observation.state"]["max"] == [39.0, 4.0]
    dataset.modality = {"state": {"x": {"start": 0, "end": 1}}, "action": {"y": {"start": 1, "end": 2, "original_key": "observation.state"}}}
    assert set(dataset.load(columns=[]).columns) == {"episode_index", "frame_index", "observation.state", "tasks", "length", "sub_tasks", "state.x", "action.y"}
    assert asked[-1] == ["observation.state", "observation.state"]
