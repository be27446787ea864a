"""Column kernels against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.functions import normalize as N
from kinetrace.functions import rotations as R
from kinetrace.operators import actions as A


def quat_matrix(q):
    x, y, z, w = np.asarray(q) / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def six(m):
    return np.concatenate((m[:, 0], m[:, 1]))


@pytest.fixture(scope="module")
def quats():
    rng = np.random.default_rng(4)
    # Half turns about each axis and nearly none among them.
    return [*rng.normal(size=(40, 4)).tolist(), [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0], [1e-9, 0.0, 0.0, 1.0], [0.6, 0.8, 0.0, 1e-12]]


@pytest.mark.parametrize("kind", ["rot6d", "quat", "quat_wxyz", "euler", "rotvec", "matrix"])
def test_every_form_round_trips(spark, quats, kind):
    df = spark.createDataFrame([(q,) for q in quats], "q array<double>")
    m = R.matrix_from_quat(F.col("q"))
    df = df.select("q", R.TO[kind](m).alias("x"))
    for r in df.select("q", "x", R.FROM[kind](F.col("x")).alias("m")).collect():
        assert len(r.x) == R.SIZE[kind]
        np.testing.assert_allclose(np.reshape(r.m, (3, 3)), quat_matrix(r.q), atol=1e-7)


def test_relative_and_absolute(spark, quats):
    rng = np.random.default_rng(5)
    rows = [([*rng.normal(size=3).tolist(), *a], [*rng.normal(size=3).tolist(), *b]) for a, b in zip(quats, quats[::-1])]
    df = spark.createDataFrame(rows, "a array<double>, r array<double>")
    out = df.select("a", "r", R.relative_pose(F.col("a"), F.col("r")).alias("rel"), R.se3_relative(F.col("a"), F.col("r")).alias("se3"))
    out = out.withColumn("back", R.absolute_pose(F.col("rel"), F.col("r"), "rot6d")).withColumn("home", R.se3_absolute(F.col("se3"), F.col("r"), "quat"))
    for x in out.collect():
        p, p0, m, m0 = np.array(x.a[:3]), np.array(x.r[:3]), quat_matrix(x.a[3:]), quat_matrix(x.r[3:])
        np.testing.assert_allclose(x.rel, [*(p - p0), *six(m0.T @ m)], atol=1e-9)
        np.testing.assert_allclose(x.se3, [*(m0.T @ (p - p0)), *six(m0.T @ m)], atol=1e-9)
        np.testing.assert_allclose(x.back, [*p, *six(m)], atol=1e-9)
        np.testing.assert_allclose(quat_matrix(x.home[3:]), m, atol=1e-7)
        np.testing.assert_allclose(x.home[:3], p, atol=1e-9)


def test_engagement_prefix(spark, quats):
    rng = np.random.default_rng(6)
    poses = [[*rng.normal(size=3).tolist(), *q] for q in quats[:8]]
    engaged = [True, True, False, False, True, True, True, False]
    for ref_on in (True, False):
        df = spark.createDataFrame([(poses[1:], engaged[1:], poses[0])], "c array<array<double>>, e array<boolean>, r array<double>")
        got = df.select(A.engaged_rel_xyz_rot6d(F.col("c"), F.col("e"), F.col("r"), F.lit(ref_on)).alias("o")).first().o
        p, m, last, on = np.zeros(3), np.eye(3), poses[0], ref_on
        for row, e, g in zip(poses[1:], engaged[1:], got, strict=True):
            if on and e:
                p = p + np.array(row[:3]) - np.array(last[:3])
                m = m @ quat_matrix(last[3:]).T @ quat_matrix(row[3:])
            last, on = row, e
            np.testing.assert_allclose(g, [*p, *six(m)], atol=1e-7)


def test_hold_zero_and_delta(spark):
    df = spark.createDataFrame([([[1.0], [2.0], [3.0]], [False, True, False], [9.0])], "c array<array<double>>, e array<boolean>, s array<double>")
    r = df.select(A.held(F.col("c"), F.col("e"), F.col("s")).alias("h"), A.zeroed(F.col("c"), F.col("e")).alias("z"), A.delta(F.col("c"), F.col("s")).alias("d"), A.delta(F.col("c")).alias("d0")).first()
    assert r.h == [[9.0], [2.0], [2.0]] and r.z == [[0.0], [2.0], [0.0]] and r.d == [[-8.0], [1.0], [1.0]] and r.d0 == [[0.0], [1.0], [1.0]]
    with pytest.raises(ValueError):
        A.clutch("left_arm", F.col("c"), {"left": F.col("e")}, relative_rot6d=False, hold=True)


def test_slerp_and_scaling(spark):
    a, b = [0.0, 0.0, 0.0, 1.0], [0.0, 0.0, math.sin(0.5), math.cos(0.5)]
    df = spark.createDataFrame([(a, b), (a, [-x for x in b]), (a, a)], "a array<double>, b array<double>")
    got = [r.s for r in df.select(R.slerp(F.col("a"), F.col("b"), F.lit(0.25)).alias("s")).collect()]
    for s, angle in zip(got, (0.125, 0.125, 0.0), strict=True):
        np.testing.assert_allclose(s, [0, 0, math.sin(angle), math.cos(angle)], atol=1e-9)
    half = df.select(R.scaled_rotation(R.rot6d_from_matrix(R.matrix_from_quat(F.col("b"))), F.lit(0.5)).alias("h")).first().h
    np.testing.assert_allclose(half, six(quat_matrix([0, 0, math.sin(0.25), math.cos(0.25)])), atol=1e-9)


def test_zero_quaternion_is_an_error(spark):
    df = spark.createDataFrame([([0.0] * 4,)], "q array<double>").select(R.matrix_from_quat(F.col("q")))
    with pytest.raises(Exception, match="norm 0"):
        df.collect()


def test_sticky_gripper(spark):
    """By the rule step by step: a - 1, doubled and turned about; above 0.5 in size it latches for so many steps."""
    df = spark.createDataFrame([([0.5, 0.4, 0.3, 0.95, 0.5, 0.5],), ([0.0, 0.5, 0.5, 1.0, 1.0, 0.6],), ([],)], "a array<double>")
    for r in df.select("a", R.sticky_gripper(F.col("a"), 2).alias("g")).collect():
        want, on, count, held = [], False, 0, 0.0
        for a in r.a:
            x = -(2 * a - 1)
            if abs(x) > 0.5 and not on:
                on, held = True, x
            if on:
                count, x = count + 1, held
            if count == 2:
                on, count, held = False, 0, 0.0
            want.append(x)
        assert r.g == pytest.approx(want)


def test_normalisation_edges(spark):
    df = spark.createDataFrame([([2.0, 5.0, -100.0],)], "x array<double>")
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    r = df.select(
        N.minmax(F.col("x"), a(0, 5, 0), a(4, 5, 1)).alias("m"), N.minmax(F.col("x"), a(0, 5, 0), a(4, 5, 1), clip=True).alias("c"),
        N.mean_std(F.col("x"), a(0, 5, 0), a(4, 0, 1)).alias("z"), N.from_mean_std(N.mean_std(F.col("x"), a(0, 5, 0), a(4, 0, 99)), a(0, 5, 0), a(4, 0, 99)).alias("b"),
    ).first()
    assert r.m == [0.0, 0.0, -201.0] and r.c == [0.0, 0.0, -1.0] and r.z == [0.5, 5.0, -5.0]
    np.testing.assert_allclose(r.b, [2.0, 5.0, -100.0])
    with pytest.raises(ValueError):
        N.denormalize_state("k", F.col("x"), {}, sin_cos_keys={"k"})
    with pytest.raises(KeyError):
        N.normalize_state("k", F.col("x"), {})
