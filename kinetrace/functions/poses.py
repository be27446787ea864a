"""Poses in the layouts of action rows, and chunks of them.

Within, a pose is nine doubles: translation and rot6d.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinetrace.schema import Layout

from . import rotations as R
from .common import at_length, doubles, let, must


def pose_of(row: Column, layout: Layout) -> Column:
    """A row in a layout as translation and rot6d; layouts without both are no poses."""
    row = doubles(row)
    if layout is Layout.DEFAULT:
        return R.from_homogeneous(row)
    if layout is Layout.XYZ_ROT6D:
        return at_length(row, 9, "a pose of translation and rot6d")
    if layout is Layout.XYZ_ROTVEC:
        return let(at_length(row, 6, "a pose of translation and rotation vector"), lambda x: F.concat(F.slice(x, 1, 3), R.rot6d_from_matrix(R.matrix_from_rotvec(F.slice(x, 4, 3)))))
    raise ValueError(f"rows of layout {layout.name} are no poses")


def row_of(pose: Column, layout: Layout) -> Column:
    """The way back: a homogeneous matrix row by row, rot6d, or a rotation vector."""
    pose = doubles(pose)
    if layout is Layout.DEFAULT:
        return R.homogeneous(pose)
    if layout is Layout.XYZ_ROT6D:
        return pose
    if layout is Layout.XYZ_ROTVEC:
        return let(pose, lambda x: F.concat(F.slice(x, 1, 3), R.rotvec_from_matrix(R.matrix_from_rot6d(F.slice(x, 4, 6)))))
    raise ValueError(f"rows of layout {layout.name} are no poses")


def pose_from(translation: Column, rotation: Column, kind: str, degrees: bool = True) -> Column:
    """A pose from its parts; Euler angles are in degrees unless said otherwise."""
    if kind not in R.FROM:
        raise ValueError(f"no rotation form {kind}")
    if kind == "euler" and degrees:
        rotation = F.transform(doubles(rotation), F.radians)
    return F.concat(at_length(doubles(translation), 3, "a translation"), R.rot6d_from_matrix(R.FROM[kind](rotation)))


def rotation_as(pose: Column, kind: str, degrees: bool = True) -> Column:
    """A pose's rotation in another form."""
    out = R.TO[kind](R.matrix_from_rot6d(F.slice(doubles(pose), 4, 6)))
    return F.transform(out, F.degrees) if kind == "euler" and degrees else out


def relative_rows(chunk: Column, reference: Column, layout: Layout) -> Column:
    """inverse(reference) * row for each row, in the layout that rows and reference have."""
    return let(pose_of(reference, layout), lambda ref: F.transform(chunk, lambda row: row_of(R.se3_relative(pose_of(row, layout), ref, "rot6d"), layout)))


def absolute_rows(chunk: Column, reference: Column, layout: Layout) -> Column:
    """reference * row for each row."""
    return let(pose_of(reference, layout), lambda ref: F.transform(chunk, lambda row: row_of(R.se3_absolute(pose_of(row, layout), ref, "rot6d"), layout)))


def same_joints(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Whether two joint vectors agree; vectors of different lengths don't."""
    near = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda ok: F.coalesce(ok, F.lit(False)))
    return F.when(F.size(a) == F.size(b), near).otherwise(False)


def joint_difference(a: Column, b: Column) -> Column:
    """a - b; different lengths are an error."""
    return F.zip_with(must(F.size(a) == F.size(b), a, "joint vectors of different lengths"), b, lambda x, y: x - y)


def difference(a: Column, b: Column, layout_a: Layout, layout_b: Layout) -> Column:
    """inverse(b) * a of two poses; poses of different layouts are not subtracted."""
    if layout_a is not layout_b:
        raise TypeError(f"a pose of {layout_a.name} and one of {layout_b.name}")
    return row_of(R.se3_relative(pose_of(a, layout_a), pose_of(b, layout_b), "rot6d"), layout_a)


def checked_times(chunk: Column, times: Column | None = None) -> Column:
    """A chunk's times, 0, 1, 2 and so on if none are given; an empty chunk or another number of times is an error."""
    filled = must(F.size(chunk) > 0, chunk, "a chunk needs a row")
    if times is None:
        return F.transform(filled, lambda _, i: i.cast("double"))
    return must(F.size(filled) == F.size(times), doubles(times), "as many times as rows are needed")


def joints_only(layout: Layout) -> Layout:
    """Joint chunks know the default layout alone."""
    if layout is not Layout.DEFAULT:
        raise ValueError(f"joint rows have no layout {layout.name}")
    return layout


def blended(a: Column, b: Column, share: Column) -> Column:
    """Between two poses: translation in a straight line, rotation along the shorter arc."""
    quat = lambda p: R.quat_from_matrix(R.matrix_from_rot6d(F.slice(p, 4, 6)))
    line = F.zip_with(F.slice(a, 1, 3), F.slice(b, 1, 3), lambda x, y: x + share * (y - x))
    return F.concat(line, R.rot6d_from_matrix(R.matrix_from_quat(R.slerp(quat(a), quat(b), share))))
