"""Action chunks re-expressed, scaled, held and undone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinetrace.functions import rotations as R
from kinetrace.functions.common import doubles, items, let


def joint_relative(chunk: Column, reference: Column) -> Column:
    """Every row less the reference."""
    return F.transform(chunk, lambda row: F.zip_with(row, reference, lambda a, b: a - b))


def joint_absolute(chunk: Column, reference: Column) -> Column:
    return F.transform(chunk, lambda row: F.zip_with(row, reference, lambda a, b: a + b))


def delta(chunk: Column, reference: Column | None = None) -> Column:
    """Every row less the one before; the first less the reference, or itself."""
    return F.transform(chunk, lambda row, t: F.zip_with(row, F.when(t > 0, F.get(chunk, t - 1)).otherwise(reference if reference is not None else chunk[0]), lambda a, b: a - b))


def rel_xyz_rot6d(chunk: Column, reference: Column, kind: str = "quat", ref_kind: str = "quat") -> Column:
    return F.transform(chunk, lambda row: R.relative_pose(row, reference, kind, ref_kind))


def abs_from_rel(chunk: Column, reference: Column, kind: str = "quat", ref_kind: str = "quat") -> Column:
    return F.transform(chunk, lambda row: R.absolute_pose(row, reference, kind, ref_kind))


def se3_chunk(chunk: Column, reference: Column, kind: str = "quat") -> Column:
    return F.transform(chunk, lambda row: R.se3_relative(row, reference, kind))


def engaged_rel_xyz_rot6d(chunk: Column, engaged: Column, reference: Column, ref_engaged: Column, kind: str = "quat", ref_kind: str | None = None) -> Column:
    """Relative poses in which only moves between two engaged steps count.

    A step's move is its pose less the one before (the reference for the first); it counts if both are engaged.
    Translations are summed, rotations multiplied, in one pass over the chunk.
    """
    pose = lambda row, form=kind: F.concat(F.slice(doubles(row), 1, 3), R.FROM[form](F.slice(doubles(row), 4, R.SIZE[form])))
    start = F.struct(
        F.array().cast("array<array<double>>").alias("out"), pose(reference, ref_kind or kind).alias("last"), ref_engaged.alias("on"),
        F.array(*[F.lit(0.0)] * 3).alias("p"), R.identity().alias("r"),
    )

    def step(s, x):
        def moved(now):
            on = s["on"] & x["on"]
            p = F.when(on, F.array(*[s["p"][i] + now[i] - s["last"][i] for i in range(3)])).otherwise(s["p"])
            turn = R.multiply(R.transposed(F.slice(s["last"], 4, 9)), F.slice(now, 4, 9))
            r = F.when(on, R.multiply(s["r"], turn)).otherwise(s["r"])
            return let(p, lambda p: let(r, lambda r: F.struct(F.array_append(s["out"], F.concat(p, R.rot6d_from_matrix(r))).alias("out"), now.alias("last"), x["on"].alias("on"), p.alias("p"), r.alias("r"))))

        return let(pose(x["row"]), moved)

    rows = F.arrays_zip(chunk.alias("row"), engaged.alias("on"))
    return F.aggregate(rows, start, step, lambda s: s["out"])


def engaged_sums(df: DataFrame, value: str, engaged: str, *, episode: str = "episode", frame: str = "frame", name: str = "moved") -> DataFrame:
    """Running sum over an episode of the moves between two engaged frames: the translation part of engaged poses."""
    w = W.partitionBy(episode).orderBy(frame)
    move = F.when(F.col(engaged) & F.lag(engaged).over(w), F.col(value) - F.lag(value).over(w))
    return df.withColumn("move_", F.coalesce(move, F.lit(0.0))).withColumn(name, F.sum("move_").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("move_")


def scaled_chunk(chunk: Column, translation: Column, rotation: Column, undo: bool = False) -> Column:
    return F.transform(chunk, lambda row: R.scaled_motion(row, translation, rotation, undo))


def held(chunk: Column, engaged: Column, state: Column) -> Column:
    """Absolute rows while engaged, else the last row given, at first the state."""
    zero = F.struct(F.array().cast("array<array<double>>").alias("out"), doubles(state).alias("last"))

    def step(s, x):
        return let(F.when(x["on"], doubles(x["row"])).otherwise(s["last"]), lambda v: F.struct(F.array_append(s["out"], v).alias("out"), v.alias("last")))

    return F.aggregate(F.arrays_zip(chunk.alias("row"), engaged.alias("on")), zero, step, lambda s: s["out"])


def zeroed(chunk: Column, engaged: Column, rot6d: bool = False) -> Column:
    """Rows while engaged, else zeros; relative rot6d poses rest at no move and the identity."""
    rest = F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, *R.IDENTITY_6D)])
    return F.zip_with(chunk, engaged, lambda row, on: F.when(on, row).otherwise(rest if rot6d else F.transform(row, lambda _: F.lit(0.0))))


def clutch(key: str, chunk: Column, engaged: dict[str, Column], *, relative_rot6d: bool, hold: bool, state: Column | None = None) -> Column:
    """What a key's chunk becomes while its side (left_ or right_ in its name) is disengaged; relative rot6d poses rest."""
    side = next((s for s in engaged if f"{s}_" in key), None)
    if side is None:
        return chunk
    if relative_rot6d:
        return zeroed(chunk, engaged[side], rot6d=True)
    if hold:
        if state is None:
            raise ValueError(f"{key} is held, which needs a state key for its first step")
        return held(chunk, engaged[side], state)
    return zeroed(chunk, engaged[side])


def xyz(pose: Column) -> list[Column]:
    return items(pose, 3)
