"""The processor against plain loops, and its errors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.operators.processor import Processor, by_row, detect_clutch
from kinetrace.schema import ENGAGED, ActionSpec, Kind, Layout, ModalitySpec, Representation

RNG = np.random.default_rng(3)


def stats(n, mean=0.1, std=0.5):
    return {"mean": [mean] * n, "std": [std] * n, "min": [-1.0] * n, "max": [1.0] * n, "q01": [-0.5] * n, "q99": [0.5] * n, "q02": [-0.4] * n, "q98": [0.4] * n}


def specs(**action):
    return {"r": {"state": ModalitySpec(("a",), sin_cos_keys=frozenset({"a"})), "action": ModalitySpec(("a",), (0, 1), (ActionSpec(**action),))}}


def frame(spark, state, chunk, **more):
    row = {"state.a": state, "action.a": chunk, **more}
    kinds = {k: "array<double>" if not isinstance(v[0], list) else "array<array<double>>" for k, v in row.items()}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` {t}" for k, t in kinds.items()))


def test_statistics_are_kept_unless_overridden():
    p = Processor(specs(), {"r": {"state": {"a": stats(2)}, "action": {"a": stats(2)}}})
    assert p.set_statistics({"r": {"state": {"a": stats(3)}}, "x": {}}) == ["r"] and p.params("r", "state", "a")["dim"] == 2
    assert p.set_statistics({"r": {"state": {"a": stats(3)}}}, override=True) == [] and p.params("r", "state", "a")["dim"] == 3
    with pytest.raises(KeyError):
        p.params("r", "action", "a")


def test_parameters():
    known = {"r": {"state": {"a": stats(2)}, "action": {"a": stats(2)}, "relative_action": {"a": stats(2, mean=9.0)}}}
    p = Processor(specs(representation=Representation.RELATIVE), known, use_percentiles=True)
    assert p.params("r", "state", "a")["min"] == [-0.5, -0.5] and p.params("r", "action", "a")["mean"] == [9.0, 9.0]
    assert p.state_dim("r") == 2 and p.state_dim("r", expanded=True) == 2 and p.action_dim("r") == 2
    assert Processor(specs(), known, sin_cos_encoding=True).state_dim("r", expanded=True) == 4
    pose = Processor(specs(representation=Representation.REL_XYZ_ROT6D, kind=Kind.EEF, layout=Layout.XYZ_ROT6D), {"r": {"action": {"a": stats(3)}}})
    assert pose.action_dim("r") == 9
    del known["r"]["relative_action"]
    with pytest.raises(ValueError):
        Processor(specs(representation=Representation.RELATIVE), known).params("r", "action", "a")


@pytest.mark.parametrize("how", ["minmax", "meanstd", "temporal_meanstd", "skip"])
def test_joint_round_trip(spark, how):
    known = {"r": {"action": {"a": stats(2)}, "relative_action": {"a": {**stats(2), "mean": [[0.1, 0.2], [0.3, 0.4]], "std": [[0.5, 0.0], [0.7, 0.8]]}}}}
    p = Processor(specs(representation=Representation.RELATIVE, normalization=how), known)
    df = frame(spark, [0.5, -0.25], [[0.6, 0.1], [0.2, -0.3]])
    if how in ("minmax",):
        known["r"]["relative_action"]["a"] |= {"min": [-1.0, -1.0], "max": [1.0, 1.0]}
        p.set_statistics(known, override=True)
    done = p.apply_action(df, "r")
    got = done.first()["action.a"]
    delta = np.array([[0.1, 0.35], [-0.3, -0.05]])
    mean, std = np.array([[0.1, 0.2], [0.3, 0.4]]), np.array([[0.5, 0.0], [0.7, 0.8]])
    want = {"minmax": delta, "skip": delta}.get(how, np.where(std == 0, delta, (delta - mean) / np.where(std == 0, 1, std)))
    assert np.allclose(got, want)
    assert np.allclose(p.unapply_action(done, "r").first()["action.a"], [[0.6, 0.1], [0.2, -0.3]])


@pytest.mark.parametrize("layout, size", [(Layout.XYZ_ROT6D, 9), (Layout.XYZ_ROTVEC, 6), (Layout.DEFAULT, 16)])
def test_relative_poses_round_trip(spark, layout, size):
    def row():
        v = RNG.normal(size=3)
        angle, axis = RNG.uniform(0.1, 2.5), RNG.normal(size=3)
        axis /= np.linalg.norm(axis)
        k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
        m = np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * k @ k
        return {9: [*v, *m[:, 0], *m[:, 1]], 6: [*v, *(axis * angle)], 16: [*np.concatenate((np.c_[m, v], [[0, 0, 0, 1]])).ravel()]}[size]

    state, chunk = [float(x) for x in row()], [[float(x) for x in row()] for _ in range(3)]
    spec = {"r": {"action": ModalitySpec(("a",), (0, 1, 2), (ActionSpec(Representation.RELATIVE, Kind.EEF, layout, normalization="skip"),))}}
    p = Processor(spec, {"r": {"action": {"a": stats(size)}, "relative_action": {"a": stats(size)}}})
    done = p.apply_action(frame(spark, state, chunk), "r")
    if layout is Layout.DEFAULT:
        t = lambda x: np.array(x).reshape(4, 4)
        assert np.allclose([t(x) for x in done.first()["action.a"]], [np.linalg.inv(t(state)) @ t(x) for x in chunk])
    assert np.allclose(p.unapply_action(done, "r").first()["action.a"], chunk, atol=1e-6)


def test_clutch_and_pass_through(spark):
    left, right = ENGAGED["left"], ENGAGED["right"]
    spec = {"r": {"action": ModalitySpec(("left_grip", "right_button", left, right), (0, 1, 2), (ActionSpec(normalization="skip", hold=True, state_key="grip"), ActionSpec(normalization="skip"), ActionSpec(), ActionSpec()), pass_through=frozenset({left, right}))}}
    p = Processor(spec)
    row = {"state.grip": [0.7], "action.left_grip": [[1.0], [2.0], [3.0]], "action.right_button": [[1.0], [1.0], [1.0]], f"action.{left}": [[0.0], [1.0], [0.0]], f"action.{right}": [[1.0], [0.0], [1.0]]}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` {'array<double>' if k.startswith('state') else 'array<array<double>>'}" for k in row))
    got = p.apply_action(df, "r")
    assert not any(c in got.columns for c in (f"action.{left}", f"action.{right}"))
    first = got.first()
    assert first["action.left_grip"] == [[0.7], [2.0], [2.0]] and first["action.right_button"] == [[1.0], [0.0], [1.0]]
    stated = df.withColumnsRenamed({f"action.{left}": f"state.{left}", f"action.{right}": f"state.{right}"})
    with pytest.raises(ValueError, match="engagement"):
        p.apply_action(stated, "r")
    assert detect_clutch({left, right, "x"}) and not detect_clutch({left})


def test_errors(spark):
    df = frame(spark, [0.5, 0.5], [[0.1, 0.2]])
    p = Processor(specs(representation=Representation.RELATIVE, state_key="other"), {"r": {"state": {"a": stats(2)}, "action": {"a": stats(2)}, "relative_action": {"a": stats(2)}}}, sin_cos_encoding=True)
    with pytest.raises(KeyError, match="other"):
        p.apply_action(df, "r")
    with pytest.raises(ValueError, match="undone"):
        p.unapply(df, "r")
    with pytest.raises(ValueError, match="training"):
        p.apply(df.drop("action.a"), "r")
    assert p.apply(df.drop("action.a"), "r", training=False).first()["state.a"] == pytest.approx([math.sin(0.5)] * 2 + [math.cos(0.5)] * 2)
    scaled = Processor(specs(representation=Representation.REL_XYZ_ROT6D, rotation="rot6d", translation_scale_key="s"), {"r": {"action": {"a": stats(9)}}})
    with pytest.raises(KeyError, match="scale s"):
        scaled.apply_action(frame(spark, [0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0], [[0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0]]), "r")
    with pytest.raises(KeyError, match="missing"):
        p.unapply_action(df.drop("action.a"), "r")


def test_padded_vectors_and_back(spark):
    known = {"r": {"state": {"a": stats(2)}, "action": {"a": stats(2)}}}
    p = Processor(specs(), known)
    df = p.joint_vectors(p.apply(frame(spark, [0.5, 0.25], [[0.1, 0.2], [0.3, 0.4]]), "r"), "r", 4, 5, 3)
    r = df.first()
    assert len(r.state) == 4 and [sum(x) for x in r.action_mask] == [2, 2, 0] and len(r.action[2]) == 5
    assert np.allclose(p.decoded(df, "r", 2).first()["action.a"], [[0.1, 0.2], [0.3, 0.4]])


def test_rows_beyond_the_statistics_take_the_last(spark):
    df = spark.createDataFrame([([[1.0], [2.0], [3.0]],)], "c array<array<double>>")
    got = df.select(by_row(F.col("c"), {"m": [[1.0], [10.0]]}, ("m",), lambda row, m: F.zip_with(row, m, lambda a, b: a * b)).alias("x")).first().x
    assert got == [[1.0], [20.0], [30.0]]
