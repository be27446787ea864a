"""Which anchors count, and which episodes."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinetrace.schema import ENGAGED, RAW_ENGAGED, RAW_LINKED

from .windows import gathered


def effective_anchors(df: DataFrame, offsets: Sequence[int], *, episode: str = "episode", frame: str = "frame", length: str | None = None) -> DataFrame:
    """Anchors whose last offset still lies in the episode (its rows, or its nominal length if that is less)."""
    n = F.count(F.lit(1)).over(W.partitionBy(episode))
    df = df.withColumn("n_", F.least(n, F.col(length)) if length else n)
    return df.where(F.col(frame) + max(offsets) < F.col("n_")).drop("n_")


def terminal_filter(df: DataFrame, offsets: Sequence[int], *, done: str = "done", episode: str = "episode", frame: str = "frame") -> DataFrame:
    """Effective anchors that end before the first done frame is reached."""
    first = F.min(F.when(F.col(done), F.col(frame))).over(W.partitionBy(episode))
    n = F.count(F.lit(1)).over(W.partitionBy(episode))
    d = max(offsets)
    limit = F.least(F.greatest(F.lit(0), n - d), F.coalesce(F.greatest(F.lit(0), first - d), n))
    return df.withColumn("limit_", limit).where(F.col(frame) < F.col("limit_")).drop("limit_")


def clutch_filter(df: DataFrame, offsets: Sequence[int], *, links: Sequence[str], engaged: Sequence[str], episode: str = "episode", frame: str = "frame") -> DataFrame:
    """Anchors over whose offsets every link column is constant and any engagement column is ever true."""
    for i, name in enumerate([*links, *engaged]):
        df = df.withColumn(f"c{i}_", gathered(name, offsets, episode=episode, frame=frame))
    constant = [F.size(F.array_distinct(f"c{i}_")) == 1 for i in range(len(links))]
    ever = [F.exists(f"c{i}_", lambda x: x) for i in range(len(links), len(links) + len(engaged))]
    keep = ever[0]
    for e in ever[1:]:
        keep = keep | e
    for c in constant:
        keep = keep & c
    return effective_anchors(df, offsets, episode=episode, frame=frame).where(keep).drop(*[f"c{i}_" for i in range(len(links) + len(engaged))])


def filter_kind(modality_keys: set[str], tag: str, features: set[str], terminal_tags: frozenset[str] = frozenset({"ucsd_dvrk"})) -> str | None:
    """clutch where both sides' engagement is declared, terminal where the tag asks for it and frames say next.done."""
    if set(ENGAGED.values()) <= modality_keys:
        return "clutch"
    return "terminal" if tag in terminal_tags and "next.done" in features else None


@dataclass(frozen=True)
class AnchorRule:
    """Which anchors of a dataset count: ``kind`` is clutch, terminal or None, chosen from the dataset's own declarations.

    clutch: over the offsets no side's link changes and some side is engaged (raw values of ``state``); terminal: the last
    offset lies before the first ``done`` frame.  In every kind the last offset lies in the episode: its rows, or its nominal
    length if that is less.
    """

    kind: str | None
    offsets: tuple[int, ...]
    state: str = "observation.state"
    done: str = "next.done"

    @classmethod
    def of(cls, dataset, tag: str, offsets: Sequence[int]) -> AnchorRule:
        """The rule of a dataset directory, from its modality and feature declarations and its robot's tag."""
        keys = {k for m in ("state", "action") for k in dataset.modality.get(m, {})}
        return cls(filter_kind(keys, tag, set(dataset.info.get("features", {}))), tuple(offsets))

    def columns(self) -> list[str]:
        """What it reads of a frame beside episode, frame and length."""
        return {"clutch": [self.state], "terminal": [self.done]}.get(self.kind, [])

    def marked(self, frames: DataFrame, *, name: str = "anchor", episode: str = "episode", frame: str = "frame", length: str | None = None) -> DataFrame:
        """Adds a boolean column: all rules share one sort of each episode."""
        w, far = W.partitionBy(episode), max(self.offsets)
        rows = F.count(F.lit(1)).over(w)
        n = F.least(rows, F.col(length)) if length else rows
        keep = F.col(frame) + far < n
        if self.kind == "terminal":
            first = F.min(F.when(F.col(f"`{self.done}`"), F.col(frame))).over(w)
            keep = keep & (first.isNull() | (F.col(frame) + far < first))
        if self.kind == "clutch":
            raw = lambda i: F.col(f"`{self.state}`")[i]
            on = (raw(RAW_ENGAGED["left"]) != 0) | (raw(RAW_ENGAGED["right"]) != 0)
            seen = gathered(F.struct(raw(RAW_LINKED["left"]).alias("left"), raw(RAW_LINKED["right"]).alias("right"), on.alias("on")), self.offsets, episode=episode, frame=frame)
            frames = frames.withColumn("seen_", seen)
            same = lambda side: F.size(F.array_distinct(F.transform("seen_", lambda x: x[side]))) == 1
            keep = keep & same("left") & same("right") & F.exists("seen_", lambda x: F.coalesce(x["on"], F.lit(False)))
        return frames.withColumn(name, keep).drop("seen_")


def parse_ranges(spec: str) -> list[tuple[int, int]]:
    """a:b, a-b and n, separated by commas or blanks; ends are included."""
    out = []
    for part in re.split(r"[,\s]+", spec.strip()):
        m = re.fullmatch(r"(\d+)(?:[:-](\d+))?", part)
        if not m:
            raise ValueError(f"{part!r} is no range")
        a, b = int(m[1]), int(m[2] or m[1])
        if b < a:
            raise ValueError(f"{part!r} ends before it starts")
        out.append((a, b))
    return out


def resolve_splits(episodes: DataFrame, splits: dict[str, str], include: Sequence[str] | None = None, exclude: Sequence[str] = (), episode: str = "episode") -> DataFrame:
    """Distinct episode ids of some splits less others, clipped to the episodes that exist.

    Names match whatever their case; an unknown included name is an error, an unknown excluded one is not; so is a choice
    that leaves nothing.
    """
    known = {name.lower(): parse_ranges(spec) for name, spec in splits.items()}
    missing = [n for n in include or () if n.lower() not in known]
    if missing:
        raise ValueError(f"unknown splits {missing}")

    def inside(names) -> Column:
        out = F.lit(False)
        for name in names:
            for a, b in known.get(name.lower(), []):
                out = out | F.col(episode).between(a, b)
        return out

    ids = episodes.select(episode).distinct()
    if include:
        ids = ids.where(inside(include))
    ids = ids.where(~inside(exclude)) if exclude else ids
    if not ids.take(1):
        raise ValueError(f"no episodes are left of {list(include or ['all'])} without {list(exclude)}")
    return ids


def filter_summary(frames: DataFrame, kept: DataFrame, episode: str = "episode") -> DataFrame:
    """One row: episodes and anchors before and after a filter, and episodes that lost all their anchors."""
    before = frames.groupBy(episode).agg(F.count("*").alias("n_"))
    after = kept.groupBy(F.col(episode).alias("e_")).agg(F.count("*").alias("k_"))
    both = before.join(after, F.col(episode) == F.col("e_"), "left")
    return both.agg(F.count("*").alias("episodes"), F.sum("n_").alias("anchors"), F.count("k_").alias("kept_episodes"), F.coalesce(F.sum("k_"), F.lit(0)).alias("kept_anchors"), F.sum(F.col("k_").isNull().cast("int")).alias("dropped_episodes"))


def low_dim_features(features: DataFrame, present: Sequence[str]) -> list[str]:
    """Names of float features that the frames have; others are skipped.  One row a declared feature."""
    names = [r.name for r in features.where(F.col("dtype").contains("float")).select("name").collect()]
    return sorted(n for n in names if n in present)


def supported(modalities: dict, known: Sequence[str] = ("video", "state", "action", "language", "mask")) -> dict:
    """Modalities that the loader knows; others are dropped."""
    return {k: v for k, v in modalities.items() if k in known}


def check_frames(needed: DataFrame, lengths: DataFrame, episode: str = "episode", frame: str = "frame", length: str = "length", clamp: bool = False) -> DataFrame:
    """Asked frames within [0, length): others are moved to the nearest one if ``clamp`` is set, else an error."""
    met = needed.join(lengths.select(F.col(episode).alias("e_"), F.col(length).alias("l_")), F.col(episode) == F.col("e_"), "left")
    inside = F.col("l_").isNotNull() & (F.col("l_") > 0) & (F.col(frame) >= 0) & (F.col(frame) < F.col("l_"))
    moved = F.greatest(F.least(F.col(frame), F.col("l_") - 1), F.lit(0)) if clamp else None
    error = F.raise_error(F.concat(F.lit("frame "), F.col(frame).cast("string"), F.lit(" is missing in episode "), F.col(episode).cast("string")))
    value = F.when(inside, F.col(frame)).when(F.col("l_") > 0, moved).otherwise(error) if clamp else F.when(inside, F.col(frame)).otherwise(error)
    return met.withColumn(frame, value).drop("e_", "l_").distinct()


def key_differences(declared: Sequence[str], df: DataFrame) -> DataFrame:
    """key, problem: declared columns that are missing, and columns that nobody declared."""
    rows = [(k, "missing") for k in declared if k not in df.columns] + [(k, "extra") for k in df.columns if k not in declared]
    return df.sparkSession.createDataFrame(sorted(rows), "key string, problem string")


def chosen_episodes(episodes: DataFrame, wanted: DataFrame, most: int | None = None, episode: str = "episode") -> DataFrame:
    """Distinct wanted ids in order, the first ``most`` of them; an id that doesn't exist is an error."""
    known = episodes.select(F.col(episode).alias("known_")).distinct()
    out = wanted.select(episode).distinct().join(known, F.col(episode) == F.col("known_"), "left")
    out = out.select(F.when(F.col("known_").isNull(), F.raise_error(F.concat(F.lit("no episode "), F.col(episode).cast("string")))).otherwise(F.col(episode)).alias(episode)).orderBy(episode)
    return out.limit(most) if most is not None else out


def contract_report(df: DataFrame, expected: dict[str, tuple[str, int | None]]) -> DataFrame:
    """column, problem, rows: what breaks the declared (type, size) of columns."""
    checks = []
    for name, (kind, size) in expected.items():
        if name not in df.columns:
            checks.append((name, "missing", F.lit(True)))
            continue
        found = df.schema[name].dataType.simpleString()
        if found != kind:
            checks.append((name, f"{found} instead of {kind}", F.lit(True)))
            continue
        checks.append((name, "null", F.col(f"`{name}`").isNull()))
        if size is not None:
            checks.append((name, "size", F.size(F.col(f"`{name}`")) != size))
    rows = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(p).alias("problem"), F.coalesce(c, F.lit(False)).cast("long").alias("bad")) for n, p, c in checks])
    return df.select(F.explode(rows).alias("c")).groupBy("c.column", "c.problem").agg(F.sum("c.bad").alias("rows")).where("rows > 0")


def flat_contract(df: DataFrame, keys: dict[str, Sequence[str]], kinds: dict[str, str]) -> DataFrame:
    """The contract of simulators' flat columns: modality.key for each key of a modality, of the modality's type."""
    return contract_report(df, {f"{m}.{k}": (kinds[m], None) for m, own in keys.items() for k in own})
