"""Rotations as Column expressions: no UDF, all in double.

A matrix is an array of nine doubles, row by row.  rot6d holds the first two columns.  Quaternions are xyzw unless order
says wxyz.  Euler angles are extrinsic xyz in radians: R = Rz Ry Rx.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import at_length, cross, dot, doubles, items, let, must

IDENTITY_6D = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
#: Norms below this count as this, and angles up to it as none.
TINY = 1e-8


def matrix_from_rot6d(r: Column) -> Column:
    """Gram-Schmidt on the two columns, their norms floored at TINY."""

    def first(x):
        n = F.greatest(F.sqrt(dot(items(x, 3), items(x, 3))), F.lit(TINY))
        return F.array(*[c / n for c in items(x, 3)])

    def rest(x, a):
        p = dot(items(a, 3), items(x, 3, 3))
        return F.array(*[b - p * c for b, c in zip(items(x, 3, 3), items(a, 3), strict=True)])

    def whole(a, b):
        a, b = items(a, 3), items(b, 3)
        c = cross(a, b)
        return F.array(*[v for i in range(3) for v in (a[i], b[i], c[i])])

    return let(at_length(doubles(r), 6, "rot6d"), lambda x: let(first(x), lambda a: let(let(rest(x, a), first), lambda b: whole(a, b))))


def rot6d_from_matrix(m: Column) -> Column:
    return let(m, lambda x: F.array(x[0], x[3], x[6], x[1], x[4], x[7]))


def matrix_from_quat(q: Column, order: str = "xyzw") -> Column:
    """Normalises first; a zero quaternion is an error."""
    at = {"xyzw": (0, 1, 2, 3), "wxyz": (1, 2, 3, 0)}[order]

    def unit(v):
        n = F.sqrt(dot(items(v, 4), items(v, 4)))
        return must(n > 0, F.array(*[v[i] / n for i in at]), "a quaternion of norm 0")

    def whole(u):
        x, y, z, w = items(u, 4)
        return F.array(
            1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
            2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
            2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
        )

    return let(let(at_length(doubles(q), 4, "a quaternion"), unit), whole)


def quat_from_matrix(m: Column, order: str = "xyzw") -> Column:
    """By the largest of the four components, so nothing small is divided by."""

    def whole(r):
        trace = r[0] + r[4] + r[8]
        w = lambda s: F.array((r[7] - r[5]) / s, (r[2] - r[6]) / s, (r[3] - r[1]) / s, s / 4)
        x = lambda s: F.array(s / 4, (r[1] + r[3]) / s, (r[2] + r[6]) / s, (r[7] - r[5]) / s)
        y = lambda s: F.array((r[1] + r[3]) / s, s / 4, (r[5] + r[7]) / s, (r[2] - r[6]) / s)
        z = lambda s: F.array((r[2] + r[6]) / s, (r[5] + r[7]) / s, s / 4, (r[3] - r[1]) / s)
        twice = lambda v: 2 * F.sqrt(F.greatest(v, F.lit(TINY * TINY)))
        return (
            F.when(trace >= F.greatest(r[0], r[4], r[8]), let(twice(1 + trace), w))
            .when((r[0] >= r[4]) & (r[0] >= r[8]), let(twice(1 + r[0] - r[4] - r[8]), x))
            .when(r[4] >= r[8], let(twice(1 + r[4] - r[0] - r[8]), y))
            .otherwise(let(twice(1 + r[8] - r[0] - r[4]), z))
        )

    out = let(m, whole)
    return out if order == "xyzw" else let(out, lambda q: F.array(q[3], q[0], q[1], q[2]))


def matrix_from_euler(e: Column) -> Column:
    """Extrinsic xyz, radians."""

    def whole(v):
        (cx, cy, cz), (sx, sy, sz) = [F.cos(x) for x in items(v, 3)], [F.sin(x) for x in items(v, 3)]
        return F.array(
            cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx,
            sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx,
            -sy, cy * sx, cy * cx,
        )

    return let(at_length(doubles(e), 3, "Euler angles"), whole)


def matrix_from_intrinsic_euler(e: Column) -> Column:
    """Intrinsic XYZ: R = Rx Ry Rz, which is extrinsic in the other order."""
    return let(doubles(e), lambda v: multiply(matrix_from_euler(F.array(v[0], F.lit(0.0), F.lit(0.0))), multiply(matrix_from_euler(F.array(F.lit(0.0), v[1], F.lit(0.0))), matrix_from_euler(F.array(F.lit(0.0), F.lit(0.0), v[2])))))


def euler_from_matrix(m: Column) -> Column:
    def whole(r):
        s = F.sqrt(r[0] * r[0] + r[3] * r[3])
        free = F.array(F.atan2(r[7], r[8]), F.atan2(-r[6], s), F.atan2(r[3], r[0]))
        locked = F.array(F.atan2(-r[5], r[4]), F.atan2(-r[6], s), F.lit(0.0))
        return F.when(s > 1e-7, free).otherwise(locked)

    return let(m, whole)


def matrix_from_rotvec(v: Column) -> Column:
    """Rodrigues; no rotation up to TINY."""

    def whole(x):
        angle = F.sqrt(dot(items(x, 3), items(x, 3)))

        def turned(t):
            k = [c / t for c in items(x, 3)]
            c, s = F.cos(t), F.sin(t)
            u = 1 - c
            return F.array(
                c + k[0] * k[0] * u, k[0] * k[1] * u - k[2] * s, k[0] * k[2] * u + k[1] * s,
                k[1] * k[0] * u + k[2] * s, c + k[1] * k[1] * u, k[1] * k[2] * u - k[0] * s,
                k[2] * k[0] * u - k[1] * s, k[2] * k[1] * u + k[0] * s, c + k[2] * k[2] * u,
            )

        return let(angle, lambda t: F.when(t > TINY, turned(t)).otherwise(identity()))

    return let(at_length(doubles(v), 3, "a rotation vector"), whole)


def rotvec_from_matrix(m: Column) -> Column:
    """Through the quaternion, which is well-conditioned at every angle."""

    def whole(q):
        s = F.sqrt(dot(items(q, 3), items(q, 3)))
        sign = F.when(q[3] < 0, -1.0).otherwise(1.0)
        angle = 2 * F.atan2(s, F.abs(q[3]))
        return F.when(s > TINY / 2, F.array(*[q[i] * sign * angle / s for i in range(3)])).otherwise(F.array(*[F.lit(0.0)] * 3))

    return let(quat_from_matrix(m), whole)


def axis_angle_from_quat(q: Column) -> Column:
    """xyzw with w clipped to [-1, 1]; zero where the angle is none."""

    def whole(v):
        w = F.greatest(F.least(v[3], F.lit(1.0)), F.lit(-1.0))
        den = F.sqrt(1 - w * w)
        return F.when(den <= TINY, F.array(*[F.lit(0.0)] * 3)).otherwise(F.array(*[v[i] * 2 * F.acos(w) / den for i in range(3)]))

    return let(doubles(q), whole)


def identity() -> Column:
    return F.array(*[F.lit(float(i in (0, 4, 8))) for i in range(9)])


def multiply(a: Column, b: Column) -> Column:
    return let(a, lambda x: let(b, lambda y: F.array(*[dot(items(x, 3, 3 * i), [y[j], y[3 + j], y[6 + j]]) for i in range(3) for j in range(3)])))


def transposed(m: Column) -> Column:
    return let(m, lambda x: F.array(*[x[3 * j + i] for i in range(3) for j in range(3)]))


def turned(m: Column, v: Column) -> Column:
    """Matrix times vector."""
    return let(m, lambda x: let(v, lambda y: F.array(*[dot(items(x, 3, 3 * i), items(y, 3)) for i in range(3)])))


FROM = {"rot6d": matrix_from_rot6d, "quat": matrix_from_quat, "quat_wxyz": lambda q: matrix_from_quat(q, "wxyz"), "euler": matrix_from_euler, "rotvec": matrix_from_rotvec, "matrix": doubles}
TO = {"rot6d": rot6d_from_matrix, "quat": quat_from_matrix, "quat_wxyz": lambda m: quat_from_matrix(m, "wxyz"), "euler": euler_from_matrix, "rotvec": rotvec_from_matrix, "matrix": lambda m: m}
SIZE = {"rot6d": 6, "quat": 4, "quat_wxyz": 4, "euler": 3, "rotvec": 3, "matrix": 9}


def _split(pose: Column, kind: str) -> tuple[Column, Column]:
    """Translation, and rotation as a matrix."""
    return F.slice(pose, 1, 3), FROM[kind](F.slice(pose, 4, SIZE[kind]))


def relative_pose(action: Column, reference: Column, kind: str = "quat", ref_kind: str = "quat") -> Column:
    """xyz less the reference's, not turned; rotation reference^T action as rot6d: nine values."""
    p, r = _split(doubles(action), kind)
    p0, r0 = _split(doubles(reference), ref_kind)
    return F.concat(F.zip_with(p, p0, lambda a, b: a - b), rot6d_from_matrix(multiply(transposed(r0), r)))


def absolute_pose(relative: Column, reference: Column, kind: str = "quat", ref_kind: str = "quat") -> Column:
    """Undoes relative_pose; the rotation comes back as ``kind``."""
    p, r = _split(doubles(relative), "rot6d")
    p0, r0 = _split(doubles(reference), ref_kind)
    return F.concat(F.zip_with(p, p0, lambda a, b: a + b), TO[kind](multiply(r0, r)))


def se3_relative(pose: Column, reference: Column, kind: str = "quat") -> Column:
    """inverse(reference) * pose: here the translation is turned into the reference's frame; rotation as rot6d."""
    p, r = _split(doubles(pose), kind)
    p0, r0 = _split(doubles(reference), kind)
    return let(transposed(r0), lambda t: F.concat(turned(t, F.zip_with(p, p0, lambda a, b: a - b)), rot6d_from_matrix(multiply(t, r))))


def se3_absolute(relative: Column, reference: Column, kind: str = "quat") -> Column:
    """reference * relative, of a rot6d pose; the rotation comes back as ``kind``."""
    p, r = _split(doubles(relative), "rot6d")
    p0, r0 = _split(doubles(reference), kind)
    return let(r0, lambda m: F.concat(F.zip_with(turned(m, p), p0, lambda a, b: a + b), TO[kind](multiply(m, r))))


def homogeneous(pose: Column, kind: str = "rot6d") -> Column:
    """Sixteen values, row by row."""
    p, r = _split(doubles(pose), kind)
    return let(p, lambda t: let(r, lambda m: F.array(*[v for i in range(3) for v in (*items(m, 3, 3 * i), t[i])], *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])))


def from_homogeneous(m: Column, kind: str = "rot6d") -> Column:
    return let(at_length(doubles(m), 16, "a homogeneous matrix"), lambda x: F.concat(F.array(x[3], x[7], x[11]), TO[kind](F.array(*[x[4 * i + j] for i in range(3) for j in range(3)]))))


def scaled_rotation(rot6d: Column, factor: Column) -> Column:
    """The rotation vector times a factor, as rot6d."""
    return rot6d_from_matrix(matrix_from_rotvec(let(rotvec_from_matrix(matrix_from_rot6d(rot6d)), lambda v: F.transform(v, lambda x: x * factor))))


def scaled_motion(pose: Column, translation: Column, rotation: Column, undo: bool = False) -> Column:
    """A relative rot6d pose with translation and rotation scaled, or unscaled."""
    pose = doubles(pose)
    factor = F.lit(1.0) / rotation if undo else rotation
    moved = F.transform(F.slice(pose, 1, 3), (lambda x: x / translation) if undo else (lambda x: x * translation))
    return F.concat(moved, scaled_rotation(F.slice(pose, 4, 6), factor))


def rot6d_rows_corrected(euler: Column, correction: list[float]) -> Column:
    """Intrinsic XYZ angles, times a fixed matrix, as the first two rows (the other rot6d layout)."""
    return let(multiply(matrix_from_intrinsic_euler(euler), F.array(*[F.lit(float(x)) for x in correction])), lambda m: F.slice(m, 1, 6))


def slerp(a: Column, b: Column, t: Column) -> Column:
    """Between unit quaternions along the shorter arc; linear where they nearly agree."""

    def unit(q):
        return let(q, lambda v: let(F.sqrt(dot(items(v, 4), items(v, 4))), lambda n: F.transform(v, lambda x: x / n)))

    def whole(x, y):
        d = dot(items(x, 4), items(y, 4))
        c = F.least(F.abs(d), F.lit(1.0))
        sign = F.when(d < 0, -1.0).otherwise(1.0)

        def mixed(angle):
            s = F.sin(angle)
            near = angle < 1e-6
            u = F.when(near, 1 - t).otherwise(F.sin((1 - t) * angle) / F.when(near, 1.0).otherwise(s))
            v = F.when(near, t).otherwise(F.sin(t * angle) / F.when(near, 1.0).otherwise(s))
            return F.zip_with(x, y, lambda p, q: u * p + v * sign * q)

        return unit(let(F.acos(c), mixed))

    return let(unit(doubles(a)), lambda x: let(unit(doubles(b)), lambda y: whole(x, y)))


def cosine(a: Column, b: Column) -> Column:
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return total(F.zip_with(a, b, lambda x, y: x * y)) / F.sqrt(total(F.transform(a, lambda x: x * x)) * total(F.transform(b, lambda x: x * x)))


def sin_cos(a: Column) -> Column:
    return F.concat(F.transform(a, F.sin), F.transform(a, F.cos))


def gripper_signed(x: Column, binarise: bool = True, invert: bool = False) -> Column:
    """[0, 1] to [-1, 1], by sign if asked, negated if asked."""
    y = 2 * x - 1
    y = F.signum(y) if binarise else y
    return -y if invert else y


def sticky_gripper(commands: Column, repeats: int) -> Column:
    """Commands in [0, 1] to relative ones, -(2 a - 1); one above 0.5 in size is held for ``repeats`` steps, its own included."""
    zero = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("held"), F.lit(0).alias("left"))

    def step(s, a):
        def moved(r):
            fresh = (s["left"] == 0) & (F.abs(r) > 0.5)
            held = F.when(fresh, r).otherwise(s["held"])
            left = F.when(fresh, repeats).otherwise(s["left"])
            out = F.when(left > 0, held).otherwise(r)
            return F.struct(F.array_append(s["out"], out).alias("out"), held.cast("double").alias("held"), F.greatest(left - 1, F.lit(0)).cast("int").alias("left"))

        return let(1 - 2 * a, moved)

    return F.aggregate(doubles(commands), zero, step, lambda s: s["out"])


def gripper_opened(x: Column) -> Column:
    """1 above 0.5, else -1."""
    return F.when(x > 0.5, 1.0).otherwise(-1.0)


def closedness(x: Column) -> Column:
    return 1 - x


def euler_in_frame(quat: Column, frame: list[float]) -> Column:
    """Extrinsic xyz angles of a wxyz quaternion's rotation times the transpose of a fixed frame."""
    return euler_from_matrix(multiply(matrix_from_quat(quat, "wxyz"), transposed(F.array(*[F.lit(float(x)) for x in frame]))))


def rmse(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(total / F.size(a))


def l1(a: Column, b: Column) -> Column:
    """Mean absolute difference."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)
