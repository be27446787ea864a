"""Merging, schedules, configurations, images and other helpers against plain loops."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.functions import poses as P
from kinetrace.operators import extensions, filters, geometry, images, joins, merge, metrics, sharding, stats, vectors, windows
from kinetrace.schema import PRETRAINED, ActionSpec, Layout, ModalitySpec, Registry, Representation, registry
from kinetrace.sources import experiment, factory, lerobot, sinks
from kinetrace.streaming.frames import grid_places


def test_tags():
    assert registry.resolve("xdof").tag == registry.resolve("XDOF_relative_eef_relative_joint").tag == "xdof_relative_eef_relative_joint"
    assert registry.resolve(" LIBERO_Panda ").horizon == 16 and registry.name_of("libero_sim") == "LIBERO_PANDA" and registry.name_of("mine") == "mine"
    assert registry.stage_of("REAL_G1") == "pretrained" and registry.stage_of("unitree_g1") == "posttrained" and registry.stage_of("new_embodiment") == "finetuned"
    assert all(name in registry.names for name in PRETRAINED) and len(registry.embodiments) == len(registry.names)
    with pytest.raises(KeyError, match="unknown"):
        registry.resolve("nobody")


def test_experiment_configuration():
    text = '{"datasets": [{"paths": ["a", "b"], "tag": "ucb_dvrk", "mix_ratio": 2.0}], "shard_size": 64}'
    config = experiment.parse(text).validate()
    assert config.shard_size == 64 and config.mixture().datasets == [("a", "ucb_dvrk", 2.0), ("b", "ucb_dvrk", 2.0)]
    assert experiment.parse(experiment.dumps(config)) == config
    for bad in ('{"datasets": []}', '{"datasets": [{"paths": ["a"], "tag": "ucb_dvrk"}], "eval_strategy": "steps"}', '{"datasets": [{"paths": ["a"], "tag": "nobody"}]}'):
        with pytest.raises((ValueError, KeyError)):
            experiment.parse(bad).validate()
    with pytest.raises(ValueError, match="has no"):
        experiment.parse('{"shards": 1}')


def one(mean, **more):
    return {"mean": [mean], "std": [1.0], "min": [mean - 2], "max": [mean + 2], "q01": [mean - 1.5], "q02": [mean - 1], "q98": [mean + 1], "q99": [mean + 1.5], **more}


def test_merge_by_embodiment(spark):
    temporal = lambda m: {k: [v, v] for k, v in one(m).items()}
    got = merge.merge_by_embodiment(spark, {"a": ("x", 3.0, {"state": {"k": one(0.0)}, "action": {"k": temporal(0.0)}}), "b": ("x", 1.0, {"state": {"k": one(2.0)}, "action": {"k": temporal(2.0)}}), "c": ("y", 1.0, {"state": {"k": one(5.0)}})})
    assert got["x"]["state"]["k"]["mean"] == [0.5] and got["x"]["state"]["k"]["max"] == [4.0] and got["y"]["state"]["k"]["q02"] == pytest.approx([4.0])
    assert got["x"]["state"]["k"]["std"] == pytest.approx([math.sqrt(0.75 * 1 + 0.25 * 5 - 0.25)])
    assert got["x"]["action"]["k"]["mean"] == [[0.5], [0.5]]
    want = extensions.mixture_quantiles(np.array([[one(m)[n][0] for n, _ in merge.KNOTS] for m in (0.0, 2.0)]), np.array([3.0, 1.0]))
    assert [got["x"]["state"]["k"][n][0] for n, _ in merge.ASKED] == pytest.approx(want)
    for broken in ({"a": {}, "b": {"state": {"k": one(0)}}}, {"a": {"state": {"k": one(0)}, "relative_action": {}}, "b": {"state": {"k": one(0)}}}, {"a": {"state": {"k": one(0)}}, "b": {"state": {"j": one(0)}}}, {"a": {"state": {"k": one(0)}}, "b": {"state": {"k": {"mean": [1.0]}}}}):
        with pytest.raises(ValueError):
            merge.checked_merge(broken, {"a": 1.0, "b": 1.0})
    with pytest.raises(ValueError):
        merge.checked_merge({"a": {"state": {"k": one(0)}}}, {"a": 0.0})


def test_shard_plan_is_the_greedy_one(spark):
    rows = [(e, f) for e in range(23) for f in range(3 + e * 7 % 19)]
    df = spark.createDataFrame(rows, "episode long, frame long")
    plan, lengths = sharding.shard_plan(df, 40, 0.5, seed=4)
    got = {(r.episode, r.piece): r.shard for r in plan.select("episode", "piece", "shard").distinct().collect()}
    order = {r.episode: r.o for r in df.select("episode", sharding.hash_order(5, "episode").alias("o")).distinct().collect()}
    sizes = {(r.episode, r.piece): r.n for r in plan.groupBy("episode", "piece").agg(F.count("*").alias("n")).collect()}
    shards = min(max(1, math.ceil(len(rows) / 40)), 23 * 2)
    heap, want = [(0, i) for i in range(shards)], {}
    for e, p in sorted(sizes, key=lambda x: (order[x[0]], *x)):
        n, i = heapq.heappop(heap)
        want[e, p] = i
        heapq.heappush(heap, (n + sizes[e, p], i))
    assert got == want and {r.shard: r.length for r in lengths.collect()} == {i: n for n, i in heap}
    assert plan.count() == len(rows)
    _, blocked = sharding.shard_plan(df, 40, 0.5, seed=4, block=6)
    sums = [r.length for r in blocked.orderBy("shard").collect()]
    assert sum(sums) == len(rows) and [r.shard for r in blocked.orderBy("shard").collect()] == list(range(len(sums)))


@pytest.mark.parametrize("block", [6, 100])
def test_shards_of_any_number_of_blocks_are_as_many_and_as_even(spark, block):
    rows = [(e, f) for e in range(23) for f in range(3 + e * 7 % 19)]
    plan, lengths = sharding.shard_plan(spark.createDataFrame(rows, "episode long, frame long"), 40, 0.5, seed=4, block=block)
    sums = [r.length for r in lengths.collect()]
    largest = max(r["count"] for r in plan.groupBy("episode", "piece").count().collect())
    assert len(sums) == math.ceil(len(rows) / 40) and sum(sums) == len(rows) == plan.count() and max(sums) - min(sums) <= largest


@pytest.mark.parametrize("block", [6, 100])
def test_neither_anchors_nor_pieces_are_gathered_at_the_driver(spark, block):
    from kinetrace.operators.blocks import written

    # Long episodes, whose files are a fraction of a byte an anchor.
    anchors = written(spark.range(23 * 4000).selectExpr("floor(id / 4000) as episode", "id % 4000 as frame").coalesce(1), "anchors")
    plan, lengths = sharding.shard_plan(anchors, 4000, 0.2, seed=4, block=block)
    assert plan.count() == 23 * 4000 and lengths.count() == 23
    for df in (plan, lengths):
        df.collect()
        joins = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
        # What is broadcast is a row for each task that ranks pieces.
        assert all("SortMergeJoin" in line or ("[part_k" in line and "BuildRight" in line) for line in joins), joins


def test_images_are_summed_over_their_buffer_and_draw_only_if_asked(monkeypatch):
    import pyarrow as pa

    from kinetrace.operators import images

    column = pa.array([b"", b"\x01\xff", b"", b"\x07" * 300, b""], pa.binary())
    assert images.byte_sums(column).tolist() == [0, 256, 0, 2100, 0]
    assert images.byte_sums(column.slice(1, 3)).tolist() == [256, 0, 2100] and images.byte_sums(column[:1]).tolist() == [0]
    assert images._Draws(2, 5).integers(1000) == np.random.default_rng([2, 5]).integers(1000)
    made, real = [], np.random.default_rng
    monkeypatch.setattr(np.random, "default_rng", lambda *a: made.append(a) or real(*a))
    images.letterbox()(np.ones((2, 3, 3), np.uint8), None, images._Draws(0, 1))
    assert not made
    a = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    assert (images.padded(a, 5, 3) == np.pad(a, [(1, 2), (0, 1), (0, 0)])).all()
    with pytest.raises(ValueError):
        images.padded(a, 1, 3)


def test_running_values_end_with_their_row():
    """A window that ends with its group is evaluated anew for every row: quadratic in an episode's length."""
    import inspect

    from kinetrace.operators import joins, windows

    for f in (windows.interpolated, joins.nearest_frames):
        assert "Between(0, W.unboundedFollowing)" not in inspect.getsource(f)


@pytest.mark.parametrize(("counted", "held"), [(False, 1_000_000), (False, 50), (None, 0)])
def test_percentiles_of_large_and_odd_groups(spark, monkeypatch, counted, held):
    monkeypatch.setattr(stats, "HELD", held)
    rng = np.random.default_rng(0)
    groups = {"spread": rng.normal(size=30_000), "outlier": np.append(rng.normal(size=20_000), 1e12), "ties": np.repeat([1.0, 2.0, 3.0], [9000, 50, 9000]), "few": rng.normal(size=7), "one": np.array([4.0]), "same": np.full(6000, 2.5), "signs": np.concatenate([-(10.0 ** rng.uniform(-300, 300, 3000)), np.zeros(900), 10.0 ** rng.uniform(-300, 300, 3000)]), None: rng.uniform(1.0, 1.01, 5000)}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("few", None)], "g string, x double")
    got = {r.g: r for r in stats.summarised(df, ["g"], "x", (0.0, 0.01, 0.5, 0.98, 1.0), counted=counted).collect()}
    for k, v in groups.items():
        want = np.percentile(v, [0, 1, 50, 98, 100])
        assert [got[k][n] for n in ("q00", "q01", "q50", "q98", "q100")] == pytest.approx(want, rel=1e-9), k
        if k != "signs":
            assert got[k]["mean"] == pytest.approx(v.mean()) and got[k]["std"] == pytest.approx(v.std(), abs=1e-9)


def test_percentiles_of_infinite_values(spark):
    df = spark.createDataFrame([(x,) for x in [float("-inf")] * 3 + [float(i) for i in range(94)] + [float("inf")] * 4], "x double")
    got = stats.ranked_percentiles(df.selectExpr("1 as g", "x"), ["g"], "x", (0.0, 0.01, 0.5, 0.99, 1.0)).first()
    assert tuple(got)[1:] == (float("-inf"), float("-inf"), 47.0, float("inf"), float("inf"))


@pytest.mark.parametrize(("offsets", "reference"), [(range(6), "s"), ([-2, 0, 3], None), (range(2, 8, 2), None)])
def test_temporal_statistics_of_marked_anchors(spark, offsets, reference):
    """Selection and counts, blocks and whole episodes, against a loop over anchors."""
    rng = np.random.default_rng(3)
    rows = [(e, f, rng.normal(size=2).tolist(), rng.normal(size=2).tolist(), bool(rng.random() < 0.7)) for e, n in ((0, 90), (1, 8), (2, 2)) for f in range(n)]
    df = spark.createDataFrame(rows, "episode int, frame long, a array<double>, s array<double>, ok boolean")
    at = {(e, f): (np.array(a), np.array(s), ok) for e, f, a, s, ok in rows}
    want = {}
    for (e, f), (_, s, ok) in at.items():
        if ok and all((e, f + d) in at for d in offsets):
            for t, d in enumerate(offsets):
                for dim in range(2):
                    want.setdefault((t, dim), []).append(at[e, f + d][0][dim] - (s[dim] if reference else 0))
    plain = stats.temporal_stats(df.where("ok or true"), "a", offsets, reference=reference, counted=True).count()
    assert plain == 2 * len(offsets)
    for counted, block in ((False, None), (True, None), (True, 16)):
        got = {(r.t, r.dim): r for r in stats.temporal_stats(df, "a", offsets, reference=reference, anchors="ok", counted=counted, block=block).collect()}
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert [got[k]["mean"], got[k]["std"], got[k]["q01"], got[k]["q98"]] == pytest.approx([np.mean(v), np.std(v), np.percentile(v, 1), np.percentile(v, 98)])
    plan = stats.temporal_stats(df, "a", offsets, reference=reference)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_splits_that_leave_nothing(spark):
    episodes = spark.range(5).withColumnRenamed("id", "episode")
    with pytest.raises(ValueError, match="no episodes"):
        filters.resolve_splits(episodes, {"a": "0:2"}, ["a"], ["A"])


def test_frames_outside_their_episode(spark):
    lengths = spark.createDataFrame([(1, 5)], "episode long, length long")
    need = spark.createDataFrame([(1, 0), (1, 7), (1, -3)], "episode long, frame long")
    assert sorted(r.frame for r in filters.check_frames(need, lengths, clamp=True).collect()) == [0, 4]
    for rows in ([(1, 7)], [(2, 0)]):
        with pytest.raises(Exception, match="missing"):
            filters.check_frames(spark.createDataFrame(rows, need.schema), lengths).collect()


def test_features_and_keys(spark):
    features = spark.createDataFrame([("a", "float32"), ("b", "int64"), ("c", "float64"), ("d", "float32")], "name string, dtype string")
    assert filters.low_dim_features(features, ["a", "b", "c"]) == ["a", "c"]
    assert filters.supported({"video": 1, "touch": 2}) == {"video": 1}
    df = spark.createDataFrame([(1, 2)], "a int, z int")
    assert [tuple(r) for r in filters.key_differences(["a", "b"], df).orderBy("key").collect()] == [("b", "missing"), ("z", "extra")]


def test_media_counts(spark):
    frames = spark.createDataFrame([(1, 0), (1, 1)], "episode long, frame long")
    media = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "episode long, frame long, image string")
    assert sorted(r.image for r in joins.with_media(frames, media, ["image"]).collect()) == ["x", "y"]
    with pytest.raises(Exception, match="differ"):
        joins.with_media(frames, media.limit(1), ["image"]).collect()


def test_chunk_checks(spark):
    df = spark.createDataFrame([([[1.0], [2.0]], [0.5, 0.7], [1.0], [1.0, 2.0])], "c array<array<double>>, t array<double>, a array<double>, b array<double>")
    r = df.select(P.checked_times(F.col("c")).alias("x"), P.checked_times(F.col("c"), F.col("t")).alias("y"), P.same_joints(F.col("a"), F.col("b")).alias("s"), P.same_joints(F.col("b"), F.col("b")).alias("e")).first()
    assert r.x == [0.0, 1.0] and r.y == [0.5, 0.7] and r.s is False and r.e is True
    for bad in (P.checked_times(F.slice("c", 1, 0)), P.checked_times(F.col("c"), F.col("a")), P.joint_difference(F.col("a"), F.col("b"))):
        with pytest.raises(Exception, match="needs a row|as many times|lengths"):
            df.select(bad).collect()
    with pytest.raises(ValueError):
        P.joints_only(Layout.XYZ_ROT6D)
    with pytest.raises(ValueError):
        P.pose_of(F.col("a"), Layout.XYZ)


def test_interpolation_errors(spark):
    samples = spark.createDataFrame([(1, 0, 0.0, [0.0]), (1, 1, 0.0, [5.0])], "episode long, frame long, t double, v array<double>")
    with pytest.raises(Exception, match="two samples"):
        windows.interpolated(samples, spark.createDataFrame([(1, 0.0)], "episode long, at double")).collect()


def test_ramp_and_checks():
    w = metrics.ramp_weights(6, 2, 2.0)
    t = np.linspace(0, 1, 6)
    ramp = (1 - np.exp(-2 * t)) / (1 - np.exp(-2))
    assert w[:2] == [0, 0] and w[2:] == pytest.approx(ramp[1:-1]) and metrics.ramp_weights(3, 3, 1.0) == [0, 0, 0]
    got = metrics.checks({"a": {"b": 1}, "c": float("nan")}, {"x": ("a.b", 1), "y": ("a.z", 2), "z": ("c", 1.0)})
    assert [(n, s) for n, s, _ in got] == [("x", "PASS"), ("y", "FAIL"), ("z", "FAIL")]


def test_agreement_and_splitting(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]])], "a array<double>, b array<double>, c array<array<double>>")
    r = df.select(metrics.agreement(F.col("a"), F.col("b")).alias("g"), *[x.alias(k) for k, x in vectors.split_chunk(F.col("c"), {"p": 1, "q": 2}, 1).items()]).first()
    assert r.g.cosine == 0.0 and r.g.l1 == 1.0 and r.p == [[1.0]] and r.q == [[2.0, 3.0]]


def test_grid_places_equal_a_loop():
    rng = np.random.default_rng(1)
    for free in (0, 3):
        t = np.sort(rng.uniform(-1, 5, 40))
        t[10] = t[9]
        sample, grid, after = grid_places(t, 0.25, 0.0, free)
        want, nxt = [], free
        for i, x in enumerate(t):
            place = math.floor(x / 0.25 + 1e-5)
            want += [(i, g) for g in range(nxt, place + 1)]
            nxt = max(nxt, place + 1)
        assert list(zip(sample.tolist(), grid.tolist(), strict=True)) == want and after == nxt
    assert grid_places(np.zeros(0), 1.0, 0.0, 7)[2] == 7


def test_image_operators():
    rng = np.random.default_rng(0)
    image, mask = rng.integers(0, 256, (7, 10, 3), np.uint8), np.zeros((7, 10), np.uint8)
    mask[:, 5:] = 4
    same = lambda op: op(image, mask, np.random.default_rng(5))
    out, m = same(images.random_crop(0.5))
    assert out.shape == (3, 5, 3) and m.shape == (3, 5) and any((image[y : y + 3, x : x + 5] == out).all() for y in range(5) for x in range(6))
    assert (same(images.random_crop(0.5))[0] == out).all()
    tinted, _ = same(images.mask_tint([4], (0.5, 0.5), p=1.0))
    assert (tinted[:, :5] == image[:, :5]).all() and (tinted[:, 5:] != image[:, 5:]).any()
    assert (same(images.mask_tint([4], p=0.0))[0] == image).all() and (images.background_noise()(image, None, np.random.default_rng(1))[0] == image).all()
    fitted, _ = same(images.resize_pad(20, 12))
    assert fitted.shape == (20, 12, 3) and not fitted[:6].any() and not fitted[14:].any() and fitted[6:14].any()
    assert np.allclose(images.resized(np.full((6, 8, 3), 77, np.uint8), 3, 17), 77)
    assert same(images.training_pipeline(8, 0.5, (6, 6), [0], [4]))[0].shape == (6, 6, 3) == same(images.evaluation_pipeline(8, 0.5, (6, 6)))[0].shape
    assert images.as_bytes(np.array([0.0, 0.5, 1.0])).tolist() == [0, 127, 255]
    with pytest.raises(ValueError):
        images.centre_crop(0.0)


def test_views_draw_alike(spark):
    rng = np.random.default_rng(0)
    rows = [(v, s, 6, 8, bytearray(rng.integers(0, 256, 144, np.uint8).tobytes())) for s in range(4) for v in ("left", "right")]
    df = spark.createDataFrame(rows, "path string, frame long, height int, width int, image binary")
    marked = df.withColumn("mask", F.unhex(F.lit("".join(f"{i:02x}" for i in range(48)))))
    got = images.transformed(marked, images.random_crop(0.5), seed=2).collect()
    places = {}
    for r in got:
        places.setdefault(r.frame, set()).add(bytes(r.mask)[0])
    assert all(len(p) == 1 for p in places.values()) and len({next(iter(p)) for p in places.values()}) > 1


def test_video_helpers():
    assert geometry.stream_info({"r_frame_rate": "30/2", "duration": "2.1", "nb_frames": 0, "codec_name": "av1"}) == {"fps": 15.0, "frames": 31, "duration": 2.1, "codec": "av1"}
    assert geometry.chosen_decoder("h264", None, lambda n: n == "av") == "av" and geometry.chosen_decoder("av1", None, lambda n: True) == "av" and geometry.chosen_decoder("h264", "decord", lambda n: True) == "decord"
    with pytest.raises(ValueError):
        geometry.chosen_decoder("h264", None, lambda n: False)
    with pytest.raises(ValueError):
        geometry.chosen_decoder(None, "cv", lambda n: True)


def test_policy_contract(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id long, x array<double>")
    make = lambda: lambda batch: {"y": [sum(v) for v in batch["x"]]}
    assert [tuple(r) for r in extensions.with_policy(df, make, "y double", {"x": ("array<double>", 2)}).collect()] == [(1, [1.0, 2.0], 3.0)]
    with pytest.raises(ValueError, match="contract"):
        extensions.with_policy(df, make, "y double", {"x": ("array<double>", 3)})
    with pytest.raises(Exception, match="one row"):
        extensions.with_policy(df, lambda: lambda batch: {"y": []}, "y double").collect()


def test_lines_and_json(spark, tmp_path):
    path = f"file://{tmp_path}"
    spark.createDataFrame([(2, "b"), (1, "a")], "task_index long, task string").write.parquet(f"{path}/tasks")
    sinks.tasks_to_lines(spark, f"{path}/tasks", f"{path}/tasks.jsonl")
    assert (tmp_path / "tasks.jsonl").read_text().splitlines() == ['{"task_index":1,"task":"a"}', '{"task_index":2,"task":"b"}']
    sinks.write_lines(spark.createDataFrame([], "task_index long"), f"{path}/none.jsonl", "task_index")
    assert (tmp_path / "none.jsonl").read_text() == ""
    assert sinks.plain({1: {2, 1}, "p": tmp_path}) == {"1": [1, 2], "p": str(tmp_path)}
    with pytest.raises(ValueError):
        sinks.check_sample({"a": 1}, ["a", "b"])
    with pytest.raises(ValueError):
        lerobot.union_of({})


def test_rebuilt_vectors(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.3], [0.4, 0.5, 0.6], 0.7, [1.0] * 7)], "xyz array<double>, euler array<double>, grip double, joints array<double>")
    eye = [1.0, 0, 0, 0, 1, 0, 0, 0, 1]
    r = sinks.rebuilt_vectors(df, ["xyz", "grip", "joints"], "euler", eye, "state").first().state
    cx, cy, cz = (math.cos(a) for a in (0.4, 0.5, 0.6))
    sx, sy, sz = (math.sin(a) for a in (0.4, 0.5, 0.6))
    m = np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]]) @ np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]]) @ np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]])
    assert len(r) == 17 and r[:3] == [0.1, 0.2, 0.3] and r[3:9] == pytest.approx(list(m[:2].ravel())) and r[9] == 0.7


def test_specs_from_json():
    spec = ModalitySpec.parse({"keys": ["a", "b"], "offsets": [0, 1], "pass_through": ["b"], "actions": [{"representation": "RELATIVE", "kind": "eef", "layout": "XYZ_ROT6D"}, {}]})
    assert spec.model_keys == ("a",) and spec.action_of("a").layout is Layout.XYZ_ROT6D and spec.action_of("b").normalization == "temporal_meanstd"
    with pytest.raises(ValueError):
        ModalitySpec.parse({"keys": ["a"], "actions": [{"representation": "sideways"}]})


def test_pose_difference_needs_one_layout(spark):
    with pytest.raises(TypeError):
        P.difference(F.col("a"), F.col("b"), Layout.DEFAULT, Layout.XYZ_ROT6D)
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0], [0.5, 0.5, 0.5, 0.0, 1.0, 0.0, -1.0, 0.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(P.difference(F.col("a"), F.col("b"), Layout.XYZ_ROT6D, Layout.XYZ_ROT6D).alias("d")).first().d
    assert got == pytest.approx([1.5, -0.5, 2.5, 0.0, -1.0, 0.0, 1.0, 0.0, 0.0])


def test_replay_needs_its_step(spark):
    df = spark.createDataFrame([(1, 0, 5)], "episode long, frame long, k long")
    with pytest.raises(ValueError, match="no step"):
        windows.replay_from(df, "k", 2, 1, 3)


def test_flat_contract(spark):
    df = spark.createDataFrame([([1.0], None)], "`state.x` array<double>, `state.y` array<double>")
    got = filters.flat_contract(df, {"state": ["x", "y", "z"]}, {"state": "array<double>"}).collect()
    assert sorted((r["column"], r.problem) for r in got) == [("state.y", "null"), ("state.z", "missing")]


def test_factory(spark, tmp_path):
    """Two datasets of one robot: statistics are written, shards planned, weights and merged statistics follow."""
    own = Registry()
    own.register("new_embodiment", {"state": ModalitySpec(("arm",)), "action": ModalitySpec(("arm",), (0, 1, 2), (ActionSpec(Representation.RELATIVE),))})
    paths = []
    for n, episodes in (("one", 4), ("two", 2)):
        root = f"file://{tmp_path}/{n}"
        frames = spark.createDataFrame([(e, f, 0, [float(f), 1.0], [float(f * e), 2.0]) for e in range(episodes) for f in range(8)], "episode_index long, frame_index long, task_index long, `observation.state` array<double>, action array<double>")
        info = {"chunks_size": 1000, "data_path": "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet", "features": {"observation.state": {"dtype": "float64", "shape": [2]}, "action": {"dtype": "float64", "shape": [2]}}, "splits": {"train": "0:100"}}
        sinks.write_dataset(frames, spark.createDataFrame([(e, ["go"], 8) for e in range(episodes)], "episode_index long, tasks array<string>, length long"), spark.createDataFrame([(0, "go")], "task_index long, task string"), info, {"state": {"arm": {"start": 0, "end": 2}}, "action": {"arm": {"start": 0, "end": 2}}}, root)
        paths.append(root)
    config = experiment.from_dict({"datasets": [{"paths": paths, "tag": "NEW_embodiment", "mix_ratio": 2.0, "include_splits": ["train"]}], "shard_size": 6, "sampling_rate": 0.5})
    mix = factory.build(spark, config, own)
    rows = {r.dataset: r for r in mix.datasets.collect()}
    assert [rows[p].shards for p in paths] == [4, 2] and rows[paths[0]].weight == pytest.approx(4 / 3) and rows[paths[1]].mean_length == 6
    assert (tmp_path / "one/meta/stats.json").exists() and (tmp_path / "two/meta/relative_stats.json").exists()
    params = mix.processor.params("new_embodiment", "action", "arm")
    assert params["dim"] == 2 and len(params["mean"]) == 3 and params["max"][0][1] == 1.0
    assert mix.schedule(10, 1).count() == 10 and mix.plans[paths[0]].count() == 24
    with pytest.raises(KeyError):
        factory.build(spark, config, Registry())
