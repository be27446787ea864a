"""Golden numbers, errors and layouts."""

import json

import pytest
from pyspark.sql import functions as F

from kinetrace.functions import language as L
from kinetrace.operators import filters, joins, merge, metrics, sharding, stats, vectors, windows
from kinetrace.schema import ActionSpec, MixtureConfig, ModalitySpec, Registry, Representation, Slice, check_language, registry
from kinetrace.sources.lerobot import TrajectoryDataset, map_cameras
from kinetrace.sources.sinks import legacy_info, sample_dataset, write_dataset, write_json, write_relative_stats, write_temporal_stats


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame([(e, f, float(f), f >= 48) for e in range(3) for f in range(50)], "episode long, frame long, v double, done boolean")


def test_effective_length(frames):
    assert filters.effective_anchors(frames, range(8)).where("episode = 0").count() == 43


def test_terminal(frames):
    assert filters.terminal_filter(frames, range(8)).where("episode = 0").count() == 41


def test_chunks_agree_between_both_plans(frames):
    few, many = [-2, 0, 3], [-2, 0, 1, 2, 3, 4]
    a = {(r.episode, r.frame): r.chunk for r in windows.chunked(frames, "v", few, pad=True).collect()}
    b = {(r.episode, r.frame): [r.chunk[i] for i in (0, 1, 4)] for r in windows.chunked(frames, "v", many, pad=True).collect()}
    assert a == b and a[0, 0] == [0.0, 0.0, 3.0] and a[0, 49] == [47.0, 49.0, 49.0]
    assert windows.chunked(frames, "v", many).count() == 3 * 44


def test_null_values_keep_their_place(spark):
    df = spark.createDataFrame([(0, i, None if i % 2 else float(i)) for i in range(6)], "episode long, frame long, v double")
    assert windows.contiguous(df, "v", 6).first().chunk == [0.0, None, 2.0, None, 4.0, None]


def test_history_offsets():
    assert windows.history_offsets([-4, -2, 0]) == [-4, -2, 0]
    for bad in ([], [-3, -1, 0], [0, 1], [-1, -2, 0]):
        with pytest.raises(ValueError):
            windows.history_offsets(bad)


def test_ranges():
    assert filters.parse_ranges("0:5, 7-9 12") == [(0, 5), (7, 9), (12, 12)]
    for bad in ("5:3", "x", ""):
        with pytest.raises(ValueError):
            filters.parse_ranges(bad)


def test_splits(frames):
    ids = lambda **k: sorted(r.episode for r in filters.resolve_splits(frames, {"A": "0:99", "b": "1"}, **k).collect())
    assert ids() == [0, 1, 2] and ids(include=["a"], exclude=["B", "nope"]) == [0, 2] and ids(include=["B"]) == [1]
    with pytest.raises(ValueError):
        ids(include=["nope"])


def test_chosen_episode_must_exist(spark, frames):
    with pytest.raises(Exception, match="no episode 7"):
        filters.chosen_episodes(frames, spark.createDataFrame([(7,)], "episode long")).collect()


def test_missing_task_is_an_error(spark):
    f, t = spark.createDataFrame([(0,), (5,)], "task_index long"), spark.createDataFrame([(0, "x")], "task_index long, task string")
    with pytest.raises(Exception, match="no task 5"):
        joins.with_task(f, t).collect()


def test_resampling(spark):
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate([-0.5, 0.0, 0.1, 0.35, 0.36, 0.5])], "episode long, frame long, t double")
    assert [(r.frame, r.grid) for r in windows.resampled(df, 0.1).orderBy("grid").collect()] == [(1, 0), (2, 1), (3, 2), (3, 3), (5, 4), (5, 5)]


def test_ranked_percentiles_equal_built_in(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 7.0).alias("x"))
    a = stats.ranked_percentiles(df, ["g"], "x", (0.01, 0.5, 0.99)).orderBy("g").collect()
    b = stats.summarised(df, ["g"], "x", (0.01, 0.5, 0.99)).orderBy("g").collect()
    for x, y in zip(a, b, strict=True):
        assert all(abs(x[q] - y[q]) < 1e-9 for q in ("q01", "q50", "q99"))


def test_merge(spark):
    df = spark.createDataFrame([("a", 0.5, 0.0, 1.0, -1.0, 1.0), ("b", 0.5, 1.0, 1.0, 0.0, 2.0)], "dataset string, weight double, mean double, std double, min double, max double").withColumn("k", F.lit(1))
    r = merge.merge_moments(df, ["k"]).first()
    assert (r.mean, r.min, r.max) == (0.5, -1.0, 2.0) and abs(r.std - 1.25**0.5) < 1e-12
    one = spark.createDataFrame([("a", 2.0, 0.0, 1.0, 2.0, 8.0, 9.0, 10.0), ("b", 1.0, 0.0, 1.0, 2.0, 8.0, 9.0, 10.0)], "dataset string, weight double, min double, q01 double, q02 double, q98 double, q99 double, max double").withColumn("k", F.lit(1))
    r = merge.merge_quantiles(one, ["k"]).first()
    assert [round(r[c], 9) for c in ("q01", "q02", "q98", "q99")] == [1.0, 2.0, 8.0, 9.0]
    flat = one.select("dataset", "weight", "k", *[F.lit(3.0).alias(c) for c in ("min", "q01", "q02", "q98", "q99", "max")])
    assert merge.merge_quantiles(flat, ["k"]).first().q01 == 3.0
    with pytest.raises(Exception, match="ascend"):
        merge.merge_quantiles(one.withColumn("q01", F.lit(5.0)), ["k"]).collect()
    with pytest.raises(Exception, match="weights"):
        merge.normalised(df.withColumn("weight", F.lit(0.0))).collect()


def test_shards(frames):
    plan, lengths = sharding.shard_plan(filters.effective_anchors(frames, range(4)), 64, 0.5)
    got = {r.shard: r.n for r in plan.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert sum(got.values()) == 3 * 47 and len(got) == 3 and got == {r.shard: r.length for r in lengths.collect()}


def test_schedule(spark):
    df = spark.createDataFrame([("a", 3.0, 10.0, 4), ("b", 1.0, 10.0, 7)], "dataset string, weight double, mean_length double, shards int")
    rows = sharding.schedule(df, 4000, seed=1).collect()
    assert 0.7 < sum(r.dataset == "a" for r in rows) / 4000 < 0.8
    full = [sorted(r.shard for r in rows if r.dataset == "a" and r.cycle == c) for c in range(5)]
    assert all(x == [0, 1, 2, 3] for x in full)


def test_schema():
    assert registry.resolve("CMR_versius").offsets[:3] == (2, 4, 6)
    assert ActionSpec.parse({"representation": "RELATIVE"}).representation is Representation.RELATIVE
    assert ModalitySpec(("a",), (2, 4, 6)).horizon == 5
    own = Registry()
    own.register("x", {})
    for bad in (lambda: own.register("x", {}), lambda: ModalitySpec(("a", "b"), actions=(ActionSpec(),)), lambda: check_language(ModalitySpec(("words",))), lambda: MixtureConfig([("d", "ucb_dvrk", 0.0)]).validate()):
        with pytest.raises(ValueError):
            bad()


def test_slices(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 9.0)], "`observation.state` array<float>, g double")
    got = vectors.select_slices(df, {"j": Slice(1, 3), "both": Slice(2, 4, original_keys=("observation.state", "g"))}, "observation.state", "state").first()
    assert got["state.j"] == [2.0, 3.0] and got["state.both"] == [3.0, 9.0]
    with pytest.raises(KeyError):
        vectors.slice_column(df, Slice(0, 1, "nope"), "action")
    assert vectors.flat(vectors.nested(spark.createDataFrame([(1, 2)], "`a.b` int, `a.c` int"))).columns == ["a.b", "a.c"]


def test_prompts(spark):
    df = spark.createDataFrame([("Héllo, Wörld! a_b", None), ("x", " NaN ")], "t string, i string")
    got = df.select(L.formalised(F.col("t")).alias("f"), L.tool_prompt([("left", F.col("i"))], F.col("t")).alias("p")).collect()
    assert got[0].f == "héllo wörld a_b" and got[0].p == "left: none. Héllo, Wörld! a_b" and got[1].p == "left: none. x"


def test_rollouts(spark):
    df = spark.createDataFrame([(0, i, 1.0, i == 1, 0.1 * i, float(i), True, i in (2, 4)) for i in range(6)], "env long, step long, reward double, success boolean, q_score double, progress double, valid boolean, done boolean")
    got = sorted(tuple(r[c] for c in ("rollout", "length", "success", "complete")) for r in metrics.rollouts(df).collect())
    assert got == [(0, 3, True, True), (1, 2, False, True), (2, 1, False, False)]
    assert metrics.success_rate(metrics.rollouts(df)).first().success_rate == 0.5
    with pytest.raises(ValueError):
        metrics.momentum(df, 1)


def test_dataset_directory(spark, tmp_path):
    root = f"file://{tmp_path}/d"
    frames = spark.createDataFrame([(e, f, 0, [float(f), 1.0, 2.0], [float(e)]) for e in range(3) for f in range(5)], "episode_index long, frame_index long, task_index long, `observation.state` array<float>, action array<float>")
    episodes = spark.createDataFrame([(e, ["go"], 4) for e in range(3)], "episode_index long, tasks array<string>, length long")
    tasks = spark.createDataFrame([(0, "go"), (1, "stop")], "task_index long, task string")
    info = {"codebase_version": "v2.1", "chunks_size": 1000, "data_path": "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet", "video_path": "videos/chunk-{episode_chunk:03d}/{video_key}/episode_{episode_index:06d}.mp4", "features": {"action": {"dtype": "float32", "shape": [1]}}}
    modality = {"state": {"tail": {"start": 1, "end": 3}}, "action": {"a": {"start": 0, "end": 1}}, "video": {"cam": {}}}
    write_dataset(frames, episodes, tasks, info, modality, root)
    data = TrajectoryDataset(spark, root)
    got = data.load()
    assert got.count() == 12 and got.orderBy("episode_index", "frame_index").first()["state.tail"] == [1.0, 2.0]
    assert data.frames([1]).count() == 5 and data.totals() == {"total_episodes": 3, "total_frames": 12, "total_chunks": 1, "total_tasks": 2}
    assert data.episodes.select(data.video_path("cam", F.col("episode_index")).alias("p")).first().p.endswith("videos/chunk-000/observation.images.cam/episode_000000.mp4")
    with pytest.raises(Exception, match="missing"):
        data.sparse(spark.createDataFrame([(0, 99)], "episode_index long, frame_index long")).collect()
    kept, own, used = sample_dataset(data.frames(), data.episodes, data.tasks, 2)
    assert (kept.count(), own.count(), used.count()) == (10, 2, 1)
    with pytest.raises(FileNotFoundError):
        TrajectoryDataset(spark, root, need_stats=True)
    with pytest.raises(FileNotFoundError):
        TrajectoryDataset(spark, f"{root}/none")


def test_json_sinks(spark, tmp_path):
    root = f"file://{tmp_path}"
    write_json(spark, {}, f"{root}/meta/info.json")
    write_relative_stats(spark, root, {"a": {"mean": [1.0]}})
    write_relative_stats(spark, root, {"a": {"mean": [2.0]}, "b": {"mean": [3.0]}})
    got = json.loads((tmp_path / "meta/relative_stats.json").read_text())
    assert got == {"a": {"mean": [1.0]}, "b": {"mean": [3.0]}}
    write_temporal_stats(spark, f"{root}/t.json", {"x": 1}, "one")
    write_temporal_stats(spark, f"{root}/t.json", {"x": 2}, "two")
    assert json.loads((tmp_path / "t.json").read_text()) == {"one": {"x": 1}, "two": {"x": 2}}
    with pytest.raises(ValueError):
        write_temporal_stats(spark, f"{root}/t.txt", {})
    with pytest.raises(ValueError):
        legacy_info({"codebase_version": "v2.1"}, {})
    assert map_cameras(["a", "b"], ["x", "y"]) == {"a": "x", "b": "y"}


def test_stats_json(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "v array<double>")
    got = stats.stats_json(stats.flat_stats(df, {"v": "v"}))
    assert got["v"]["mean"] == [2.0, 3.0] and stats.valid_stats(got) and not stats.valid_stats({"v": {}})
