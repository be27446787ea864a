"""Exact statistics of vectors and of horizon windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinetrace.functions.poses import relative_rows
from kinetrace.schema import ActionSpec, Kind, Layout, Representation, Slice

from .actions import joint_relative, rel_xyz_rot6d, scaled_chunk
from .blocks import haloed, written
from .filters import low_dim_features, resolve_splits
from .vectors import as_vector

FLAT, TEMPORAL = (0.01, 0.99), (0.01, 0.02, 0.98, 0.99)


def _named(percentiles: Sequence[float]) -> list[str]:
    return [f"q{round(p * 100):02d}" for p in percentiles]


def _moments(value: str) -> list[Column]:
    return [F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")]


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of df from the sizes of the files that it reads; large where it can't tell."""
    return int(df._jdf.queryExecution().analyzed().stats().sizeInBytes())


#: Estimated bytes of input up to which counts of distinct values are held in memory, one pass for all.
SMALL = 64 << 20


def summarised(df: DataFrame, keys: Sequence[str], value: str, percentiles: Sequence[float], *, counted: bool | None = None, long: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Mean, population deviation, least, greatest and linearly interpolated percentiles of a group's values.

    Percentiles come from ``ranked_percentiles``, whose memory a group's size doesn't change, or if Spark puts the input at
    SMALL bytes or less, from its ``percentile``: one pass, which keeps a count for each distinct value of a group.
    ``counted`` asks for the one or the other.  ``long`` makes keys and the value of df's rows.
    """
    if not (estimated_bytes(df) <= SMALL if counted is None else counted):
        return ranked_percentiles(df, keys, value, percentiles, moments=True, long=long)
    own = (df if long is None else long(df)).select(*keys, F.col(value).cast("double").alias("v_"))
    quantiles = F.percentile("v_", F.array(*[F.lit(p) for p in percentiles]))
    out = own.groupBy(*keys).agg(*_moments("v_"), quantiles.alias("q_"))
    return out.select(*keys, "mean", "std", "min", "max", *[F.col("q_")[i].alias(n) for i, n in enumerate(_named(percentiles))])


#: Cells of values for each doubling; values of a range up to which they are put in order; parts in which a larger one is cut.
CELLS, HELD, PARTS = 16, 1_000_000, 4096
#: Ascending numbers of ranges of values, CELLS for each doubling; infinite values and NaN have their own.
_CELL = """CASE WHEN isnan(v_) THEN 1L << 24 WHEN abs(v_) = double('infinity') THEN cast(signum(v_) AS long) * (1L << 23)
  WHEN v_ > 0 THEN floor(log2(v_) * {n}) + (1L << 20) WHEN v_ < 0 THEN -(floor(log2(-v_) * {n}) + (1L << 20)) ELSE 0L END"""


def _met(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", also: str | None = None) -> DataFrame:
    """left with the columns of right's row for its keys, nulls being equal."""
    right = right.withColumnsRenamed({k: f"{k}_k" for k in keys})
    test = " AND ".join([*[f"`{k}` <=> `{k}_k`" for k in keys], *([also] if also else [])]) or "true"
    return left.join(right, F.expr(test), how).drop(*[f"{k}_k" for k in keys])


def ranked_percentiles(df: DataFrame, keys: Sequence[str], value: str, percentiles: Sequence[float], *, moments: bool = False, long: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The exact percentiles of groups of any size, by radix selection over a written projection.

    ``df`` is written once; ``long`` makes keys and values of what was written, so that vectors are written as they are.  The
    first pass counts values by ranges of their leading digits, which with running sums tells in which range a percentile's
    ranks lie.  While such a range holds more than HELD values it is cut in PARTS and only its own values are counted again.
    The last pass puts the values of the ranges in order: some in a hundred of a group, or none where all are equal.
    """
    spread = written(df.select(*keys, F.col(value).cast("double").alias("v_")) if long is None else df, "values")
    own = (spread if long is None else long(spread)).where("v_ is not null")
    names, every = _named(percentiles), range(len(percentiles))
    by = ", ".join(f"`{k}`" for k in keys)
    rank = [f"({float(p)!r}D * (all_ - 1))" for p in percentiles]

    def ranges(marked: str) -> list[Column]:
        """For each percentile i, where its two ranks lie.  In one cell: that cell's least value a and greatest b, its rows c and
        the rows f below it; c is null if nothing is left to look for.  In two: the greatest of the first, the least of the second."""
        out = []
        for i in every:
            low, high = (f"{marked.format(i=i)} AND to_ > {r}({rank[i]}) AND to_ - n_ <= {r}({rank[i]})" for r in ("floor", "ceil"))
            both = f"FILTER (WHERE {low} AND to_ > ceil({rank[i]}))"
            out += [F.expr(x) for x in (
                f"coalesce(min(lo_) {both}, min(hi_) FILTER (WHERE {low})) AS a{i}_", f"coalesce(max(hi_) {both}, max(lo_) FILTER (WHERE {high})) AS b{i}_",
                f"sum(if(lo_ < hi_, n_, null)) {both} AS c{i}_", f"min(to_ - n_) {both} AS f{i}_",
            )]
        return out

    def kept(found: DataFrame) -> tuple[DataFrame, int]:
        seen = Observation()
        most = ", ".join(f"c{i}_" for i in every)
        return written(found.observe(seen, F.expr(f"max(array_max(array({most}))) AS most")), "ranges"), seen.get["most"] or 0

    def inside(asked: DataFrame) -> DataFrame:
        """keys, i_, v_ of values within the range of percentile i_: a, b, f (rows below it), all_ (the group's rows)."""
        hits = [f"(c{i}_ IS NOT NULL AND v_ BETWEEN a{i}_ AND b{i}_)" for i in every]
        rows = ", ".join(f"if({h}, named_struct('i_', {i}, 'a', a{i}_, 'b', b{i}_, 'f', f{i}_), null)" for i, h in enumerate(hits))
        return _met(own, asked, keys, also=f"({' OR '.join(hits)})").selectExpr(*[f"`{k}`" for k in keys], "v_", "all_", f"inline(array_compact(array({rows})))")

    cells = own.groupBy(*keys, F.expr(_CELL.format(n=CELLS)).alias("cell_")).agg(*[F.expr(x) for x in ("count(*) AS n_", "min(v_) AS lo_", "max(v_) AS hi_", "avg(v_) AS m_", "var_pop(v_) * count(*) AS s_")])
    over = f"OVER (PARTITION BY {by})"
    cells = cells.selectExpr("*", f"sum(n_) {over} AS all_", f"sum(n_) OVER (PARTITION BY {by} ORDER BY cell_ ROWS UNBOUNDED PRECEDING) AS to_", f"sum(n_ * m_) {over} / sum(n_) {over} AS mean")
    # The deviation of a group from those of its cells.
    known = ("first(all_) AS all_", "first(mean) AS mean", "sqrt(sum(s_ + n_ * (m_ - mean) * (m_ - mean)) / first(all_)) AS std", "min(lo_) AS min", "max(hi_) AS max")
    asked, most = kept(cells.groupBy(*keys).agg(*[F.expr(x) for x in known], *ranges("true")))
    while most > HELD:
        finer = inside(asked).groupBy(*keys, "i_", F.expr(f"floor((v_ - a) / (b - a) * {PARTS})").alias("cell_"))
        finer = finer.agg(*[F.expr(x) for x in ("count(*) AS n_", "min(v_) AS lo_", "max(v_) AS hi_", "first(f) AS f", "first(all_) AS all_")])
        finer = finer.selectExpr("*", f"f + sum(n_) OVER (PARTITION BY {by}, i_ ORDER BY cell_ ROWS UNBOUNDED PRECEDING) AS to_")
        new = [f"{c}{i}_" for i in every for c in "abcf"]
        finer = finer.groupBy(*keys).agg(*ranges("i_ = {i}")).withColumnsRenamed({c: f"{c}n" for c in new})
        asked, most = kept(_met(asked, finer, keys, "left").selectExpr(*[f"`{k}`" for k in keys], "all_", "mean", "std", "min", "max", *[f"if(c{i}_ IS NULL, {c}{i}_, {c}{i}_n) AS {c}{i}_" for i in every for c in "abcf"]))

    counts = inside(asked).groupBy(*keys, "i_", "v_", "f", "all_").agg(F.expr("count(*) AS n_"))
    counts = counts.selectExpr("*", f"f + sum(n_) OVER (PARTITION BY {by}, i_ ORDER BY v_ ROWS UNBOUNDED PRECEDING) AS to_")
    # Of ascending values, the first whose rows reach a rank holds it.
    found = counts.groupBy(*keys).agg(*[F.expr(f"min(v_) FILTER (WHERE i_ = {i} AND to_ > {f}({rank[i]})) AS {n}{i}_") for i in every for n, f in (("low", "floor"), ("high", "ceil"))])
    out = _met(asked, found, keys, "left")
    out = out.selectExpr("*", *[f"if(c{i}_ IS NULL, {a}{i}_, {x}{i}_) AS {x}_{i}_" for i in every for a, x in (("a", "low"), ("b", "high"))])
    parts = [f"if(low_{i}_ = high_{i}_, low_{i}_, low_{i}_ + ({rank[i]} - floor({rank[i]})) * (high_{i}_ - low_{i}_)) AS {n}" for i, n in enumerate(names)]
    return out.selectExpr(*[f"`{k}`" for k in keys], *(["mean", "std", "min", "max"] if moments else []), *parts)


def flat_stats(df: DataFrame, features: dict[str, str | Column], percentiles: Sequence[float] = FLAT, *, counted: bool | None = None) -> DataFrame:
    """feature, dim and statistics of array columns, all features in one scan; vectors of large tables are written once."""
    names = list(features)
    wide = df.select(*[(F.col(c) if isinstance(c, str) else c).cast("array<double>").alias(f"c{i}_") for i, c in enumerate(features.values())])

    def long(wide: DataFrame) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(k).alias("feature"), F.col(f"c{i}_").alias("x")) for i, k in enumerate(names)])
        return wide.select(F.explode(rows).alias("f")).select("f.feature", F.posexplode("f.x").alias("dim", "v_"))

    return summarised(wide, ["feature", "dim"], "v_", percentiles, counted=counted, long=long)


def stats_over_chunks(chunks: DataFrame, key: Column, chunk: str, percentiles: Sequence[float] = TEMPORAL, *, counted: bool | None = None) -> DataFrame:
    """key, t, dim and statistics of (horizon, dim) chunks; those of large tables are written once."""

    def long(rows: DataFrame) -> DataFrame:
        return rows.select("key", F.posexplode("rows").alias("t", "row")).select("key", "t", F.posexplode("row").alias("dim", "v_"))

    wide = chunks.select(key.alias("key"), F.col(chunk).cast("array<array<double>>").alias("rows"))
    return summarised(wide, ["key", "t", "dim"], "v_", percentiles, counted=counted, long=long)


def stepped(frames: DataFrame, value: Column | str, offsets: Sequence[int], *, anchors: str | None = None, name: str = "chunk", episode: str = "episode", frame: str = "frame", block: int | None = None) -> DataFrame:
    """Anchors whose every offset lies in their episode, with the values there: one lead or lag for each step, nothing gathered.

    ``anchors`` names a boolean column of those that count.  ``block`` cuts episodes in blocks with halos (frames are then
    places from 0).
    """
    keys, low, high = [episode], min(0, *offsets), max(0, *offsets)
    value = F.col(value) if isinstance(value, str) else value
    if block is not None:
        frames, keys = haloed(frames, low, high, block, frame=frame), [episode, "block_"]
    w = W.partitionBy(*keys).orderBy(frame)
    at = lambda c, d: F.lead(c, d).over(w) if d >= 0 else F.lag(c, -d).over(w)
    there = at(F.lit(1), high).isNotNull() & at(F.lit(1), low).isNotNull()
    out = frames.withColumns({name: F.array(*[at(value, d) for d in offsets]), "there_": there})
    if block is not None:
        out = out.where("own_").drop("own_", "block_")
    return (out if anchors is None else out.where(F.col(anchors))).where("there_").drop("there_")


def temporal_stats(frames: DataFrame, action: str, offsets: Sequence[int], *, key: str = "action", reference: str | None = None, percentiles: Sequence[float] = TEMPORAL, anchors: str | None = None, episode: str = "episode", frame: str = "frame", block: int | None = None, counted: bool | None = None) -> DataFrame:
    """Statistics of an action at each step of the horizon, over all anchors whose horizon lies in their episode, or of those
    that a boolean column ``anchors`` marks.

    With a reference (a state column) the action is taken less its value at the anchor.  Without one, step t's values are
    those of frames anchor + t, so a frame has the steps for which it counts.
    """
    own = frames.select(F.col(episode).alias("episode"), F.col(frame).alias("frame"), F.col(action).cast("array<double>").alias("a_"), (F.col(reference) if reference else F.lit(None)).cast("array<double>").alias("r_"), (F.col(anchors) if anchors else F.lit(True)).alias("valid_"))
    if reference is not None:
        chunks = stepped(own, "a_", offsets, anchors="valid_", block=block)
        return stats_over_chunks(chunks.select(joint_relative(F.col("chunk"), F.col("r_")).alias("chunk")), F.lit(key), "chunk", percentiles, counted=counted)
    keys, low, high = ["episode"], min(0, *offsets), max(0, *offsets)
    if block is None and anchors is None:
        # Which anchors are whole follows from the frame's place and the episode's length.
        n = F.count(F.lit(1)).over(W.partitionBy("episode"))
        own = own.withColumn("n_", n).withColumn("steps_", F.array(*[(F.col("frame") - d + low >= 0) & (F.col("frame") - d + high < F.col("n_")) for d in offsets]))
    else:
        if block is not None:
            # A frame sees its anchors, and these whether their own horizon is whole.
            own, keys = haloed(own, min(-high, low) + min(0, low - high), max(-low, high) + max(0, high - low), block), ["episode", "block_"]
        w = W.partitionBy(*keys).orderBy("frame")
        at = lambda c, d: F.lead(c, d).over(w) if d >= 0 else F.lag(c, -d).over(w)
        own = own.withColumn("valid_", F.col("valid_") & at(F.lit(1), high).isNotNull() & at(F.lit(1), low).isNotNull())
        own = own.withColumn("steps_", F.array(*[F.coalesce(at(F.col("valid_"), -d), F.lit(False)) for d in offsets]))
        own = own if block is None else own.where("own_")
    own = own.select("a_", "steps_")

    def long(rows: DataFrame) -> DataFrame:
        counted = rows.select("a_", F.posexplode("steps_").alias("t", "on_")).where("on_")
        return counted.select(F.lit(key).alias("key"), "t", F.posexplode("a_").alias("dim", "v_"))

    return summarised(own, ["key", "t", "dim"], "v_", percentiles, counted=counted, long=long)


def stats_json(stats: DataFrame, key: str = "feature") -> dict:
    """The nested layout of statistics files: key -> statistic -> [dim], or [t][dim] where there is a t.

    Collects one row per key, step and dimension, which is bounded by the declared schema, not by the data.
    """
    out: dict = {}
    names = [c for c in stats.columns if c not in (key, "t", "dim")]
    for row in stats.orderBy(*[c for c in (key, "t", "dim") if c in stats.columns]).collect():
        own = out.setdefault(row[key], {n: [] for n in names})
        for n in names:
            if "t" in stats.columns:
                while len(own[n]) <= row["t"]:
                    own[n].append([])
                own[n][row["t"]].append(row[n])
            else:
                own[n].append(row[n])
    return out


#: What statistics of a feature, and those that mixtures are merged from, must have.
REQUIRED = ("mean", "std", "min", "max", "q01", "q99")
MERGED = (*REQUIRED, "q02", "q98")


def valid_stats(stats: dict, needed: Sequence[str] = REQUIRED, features: Sequence[str] = ()) -> bool:
    """Whether every feature, the given ones among them, has all statistics."""
    return all(f in stats for f in features) and all(all(n in own for n in needed) for own in stats.values())


def missing_stats(stats: dict, needed: Sequence[str] = MERGED) -> list[str]:
    """feature.statistic for each that is needed and not there."""
    return sorted(f"{f}.{n}" for f, own in stats.items() for n in needed if n not in own)


def pose_stats(frames: DataFrame, action: str | Column, reference: str, offsets: Sequence[int], spec: ActionSpec, *, key: str, scales: tuple[str | None, str | None] = (None, None), anchors: str | None = None, episode: str = "episode", frame: str = "frame", block: int | None = None) -> DataFrame:
    """Statistics, step by step, of poses relative to the anchor's: translation less the reference's, rotations turned back,
    motion scaled; of poses with rot6d only the translation counts, since the rotation is bounded as it is."""
    chunks = stepped(frames, action, offsets, anchors=anchors, episode=episode, frame=frame, block=block)
    rows = rel_xyz_rot6d(F.col("chunk"), F.col(reference), spec.rotation, spec.reference)
    if any(scales):
        rows = scaled_chunk(rows, *[F.col(s)[0].cast("double") if s else F.lit(1.0) for s in scales])
    if spec.kind is Kind.EEF and spec.layout is Layout.XYZ_ROT6D:
        rows = F.transform(rows, lambda row: F.slice(row, 1, 3))
    return stats_over_chunks(chunks.select(rows.alias("chunk")), F.lit(key), "chunk")


def relative_stats(frames: DataFrame, actions: dict[str, ActionSpec], offsets: Sequence[int], *, keys: Sequence[str] | None = None, episode: str = "episode", frame: str = "frame", block: int | None = None) -> dict[str, DataFrame]:
    """Statistics of actions re-expressed against the anchor's state, for keys declared relative (or some of them).

    Poses by the inverse of the reference, joints by subtraction.  Frames hold action.* and state.* columns.
    """
    out = {}
    for name, spec in sorted(actions.items()):
        if spec.representation is not Representation.RELATIVE or (keys is not None and name not in keys):
            continue
        chunks = stepped(frames, F.col(f"`action.{name}`"), offsets, episode=episode, frame=frame, block=block)
        reference = F.col(f"`state.{spec.state_key or name}`")
        rows = relative_rows(F.col("chunk"), reference, spec.layout) if spec.kind is Kind.EEF else joint_relative(F.col("chunk"), reference)
        out[name] = stats_over_chunks(chunks.select(rows.alias("chunk")), F.lit(name), "chunk", FLAT)
    return out


def dataset_stats(dataset, episodes: DataFrame | None = None) -> dict:
    """Flat statistics of a dataset's float features, over all episodes or some (episode_index), in the layout of stats.json."""
    names = low_dim_features(dataset.features, dataset.frames().columns)
    frames = dataset.frames(columns=names)
    if episodes is not None:
        frames = frames.join(episodes.select("episode_index").distinct(), "episode_index", "left_semi")
    return stats_json(flat_stats(frames, {n: as_vector(frames, n) for n in names}))


def ensure_stats(dataset, actions: dict[str, ActionSpec], offsets: Sequence[int], include: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> list[str]:
    """Writes the statistics that a dataset lacks and returns the files written.

    Flat ones where stats.json is missing or incomplete; relative ones for declared keys that neither relative_stats.json
    nor temporal_stats.json has.  With splits only their episodes count, and relative statistics of all keys are made anew.
    """
    from kinetrace.sources.sinks import write_relative_stats, write_stats

    some = None
    if include or exclude:
        known = dataset.episodes.select(F.col("episode_index").alias("episode"))
        some = resolve_splits(known, dataset.info.get("splits", {}), include, exclude).withColumnRenamed("episode", "episode_index")
    written = []
    names = low_dim_features(dataset.features, dataset.frames().columns)
    if not valid_stats(dataset.stats or {}, features=names):
        write_stats(dataset.spark, dataset.root, dataset_stats(dataset, some))
        written.append("stats.json")
    wanted = sorted(k for k, s in actions.items() if s.representation is Representation.RELATIVE)
    have = set(dataset.relative_stats or {}) if some is None else set()
    in_temporal = set((dataset.temporal_stats or {}).get("relative_action", {}))
    missing = [k for k in wanted if k not in have]
    if missing and not set(wanted) <= in_temporal:
        frames = dataset.load(columns=[])
        frames = frames if some is None else frames.join(some, "episode_index", "left_semi")
        made = relative_stats(frames, actions, offsets, keys=missing, episode="episode_index", frame="frame_index")
        write_relative_stats(dataset.spark, dataset.root, {k: stats_json(df, "key")[k] for k, df in made.items()}, overwrite=list(made))
        written.append("relative_stats.json")
    return written


def sliced_stats(stats: dict, slices: dict[str, Slice], default: str) -> dict:
    """Statistics of named slices, cut from those of their column, or of several columns put together."""
    out: dict = {}
    for key, s in slices.items():
        names = s.original_keys or (s.original_key or default,)
        missing = [n for n in names if n not in stats]
        if missing:
            raise KeyError(f"no statistics of {missing}; there are {sorted(stats)}")
        for kind in stats[names[0]]:
            lacking = [n for n in names if kind not in stats[n]]
            if lacking:
                raise KeyError(f"{kind} is missing for {lacking}")
            flat = [x for n in names for x in (stats[n][kind] if isinstance(stats[n][kind], list) else [stats[n][kind]])]
            out.setdefault(key, {})[kind] = flat[s.start : s.end]
    return out


def dataset_statistics(dataset) -> dict:
    """modality -> key -> statistics of a dataset, relative ones as they are."""
    out = {m: sliced_stats(dataset.stats or {}, dataset.slices(m), default) for m, default in (("state", "observation.state"), ("action", "action"))}
    return {**out, **({"relative_action": dataset.relative_stats} if dataset.relative_stats else {})}
