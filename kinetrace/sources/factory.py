"""From an experiment's configuration to its mixture: statistics ensured, shards planned, weights, a processor."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.operators import filters, sharding, stats
from kinetrace.operators.blocks import written
from kinetrace.operators.merge import merge_by_embodiment
from kinetrace.operators.processor import Processor
from kinetrace.schema import Registry, Representation, registry

from .experiment import ExperimentConfig
from .lerobot import TrajectoryDataset


@dataclass
class Mixture:
    """datasets: (dataset, tag, filter, anchors, weight, mean_length, shards); plans: each dataset's anchors with piece and shard;
    statistics: what each dataset adds to the merged ones."""

    datasets: DataFrame
    plans: dict[str, DataFrame]
    sources: dict[str, TrajectoryDataset]
    statistics: dict[str, dict]
    processor: Processor

    def schedule(self, draws: int, seed: int, epoch: int = 0) -> DataFrame:
        return sharding.schedule(self.datasets, draws, seed, epoch)


def chosen(dataset: TrajectoryDataset, include: list[str], exclude: list[str]) -> DataFrame | None:
    """episode_index of the splits asked for; None for all."""
    if not include and not exclude:
        return None
    known = dataset.episodes.select(F.col("episode_index").alias("episode"))
    return filters.resolve_splits(known, dataset.info.get("splits", {}), include or None, exclude).withColumnRenamed("episode", "episode_index")


def _of(frames: DataFrame, some: DataFrame | None) -> DataFrame:
    return frames if some is None else frames.join(some, "episode_index", "left_semi")


def temporal(dataset: TrajectoryDataset, spec, tag: str, some: DataFrame | None = None) -> dict:
    """What a mixture is merged from: states flat, actions step by step, relative actions where any are declared.

    All over the anchors that the dataset's filter (clutch, terminal or none) leaves of all episodes or some
    (episode_index); states are those at the anchor's last state offset, poses count as the model sees them.
    """
    rule = filters.AnchorRule.of(dataset, tag, spec["action"].offsets)
    names = {"episode": "episode_index", "frame": "frame_index"}
    frames = rule.marked(_of(dataset.load(columns=rule.columns()), some), length="length", **names)
    states = {k: f"state.{k}" for k in spec["state"].keys}
    actions = {k: f"action.{k}" for k in spec["action"].model_keys}
    extra = {f"state.{x}" for k in actions if (a := spec["action"].action_of(k)) for x in (a.state_key or k, a.translation_scale_key, a.rotation_scale_key) if x}
    wanted = [c for c in dict.fromkeys([*states.values(), *actions.values(), *sorted(extra)]) if c in frames.columns]
    # One projection serves all keys, so the filter runs once.
    frames = written(frames.select("episode_index", "frame_index", "anchor", *[F.col(f"`{c}`") for c in wanted]), "marked")
    out: dict = {"state": {}, "action": {}}
    seen = stats.stepped(frames, F.struct(*[F.col(f"`{c}`").alias(k) for k, c in states.items()]), [spec["state"].offsets[-1]], anchors="anchor", name="s_", **names)
    out["state"] = stats.stats_json(stats.flat_stats(seen, {k: F.col("s_")[0][k] for k in states}, stats.TEMPORAL))
    for key, name in actions.items():
        action, column = spec["action"].action_of(key), f"`{name}`"
        if action is not None and action.representation is Representation.REL_XYZ_ROT6D:
            scales = tuple(f"`state.{s}`" if s else None for s in (action.translation_scale_key, action.rotation_scale_key))
            made = stats.pose_stats(frames, F.col(column), f"`state.{action.state_key or key}`", spec["action"].offsets, action, key=key, scales=scales, anchors="anchor", **names)
        else:
            made = stats.temporal_stats(frames, column, spec["action"].offsets, key=key, anchors="anchor", **names)
        out["action"][key] = stats.stats_json(made, "key")[key]
        if action is not None and action.representation is Representation.RELATIVE:
            less = stats.temporal_stats(frames, column, spec["action"].offsets, key=key, reference=f"`state.{action.state_key or key}`", anchors="anchor", **names)
            out.setdefault("relative_action", {})[key] = stats.stats_json(less, "key")[key]
    return out


def planned_anchors(dataset: TrajectoryDataset, tag: str, offsets, some: DataFrame | None = None) -> tuple[filters.AnchorRule, DataFrame]:
    """A dataset's filter, and the anchors (episode, frame) that it leaves, written once; none left is an error.

    Of the frames only what the filter reads is asked for."""
    rule = filters.AnchorRule.of(dataset, tag, offsets)
    frames = _of(dataset.bounded_frames(columns=rule.columns()), some).select(F.col("episode_index").alias("episode"), F.col("frame_index").alias("frame"), "length", *[F.col(f"`{c}`") for c in rule.columns()])
    anchors = written(rule.marked(frames, length="length").where("anchor").select("episode", "frame"), "anchors")
    if not anchors.take(1):
        raise ValueError(f"{dataset.root} has no anchor left ({rule.kind or 'no'} filter)")
    return rule, anchors


def build(spark: SparkSession, config: ExperimentConfig, known: Registry = registry) -> Mixture:
    """The mixture that a configuration asks for.  Datasets are planned one by one, each as distributed jobs."""
    config.validate()
    rows, plans, sources, merged = [], {}, {}, {}
    for group in config.datasets:
        tag = known.resolve(group.tag).tag
        if tag not in known.specs:
            raise KeyError(f"{tag} has no registered modalities")
        spec, planned = known.specs[tag], []
        for path in group.paths:
            data = TrajectoryDataset(spark, path)
            actions = dict(zip(spec["action"].keys, spec["action"].actions, strict=True)) if spec["action"].actions else {}
            stats.ensure_stats(data, actions, spec["action"].offsets, group.include_splits or None, group.exclude_splits)
            data = data.reread(need_stats=True)
            some = chosen(data, group.include_splits, group.exclude_splits)
            rule, anchors = planned_anchors(data, tag, spec["action"].offsets, some)
            plan, lengths = sharding.shard_plan(anchors, config.shard_size, config.sampling_rate, config.seed)
            n, mean, kept = lengths.agg(F.count("*"), F.avg("length"), F.sum("length")).first()
            planned.append((path, tag, rule.kind, kept, n, mean, some))
            plans[path], sources[path] = plan, data
        total = sum(n for *_, n, _, _ in planned)
        for path, own, kind, kept, n, mean, some in planned:
            weight = n / total * group.mix_ratio
            rows.append((path, own, kind, kept, weight, mean, n))
            merged[path] = (own, weight, sources[path].temporal_stats or temporal(sources[path], spec, own, some))
    datasets = spark.createDataFrame(rows, "dataset string, tag string, filter string, anchors long, weight double, mean_length double, shards long")
    return Mixture(datasets, plans, sources, {p: s for p, (_, _, s) in merged.items()}, Processor(known.specs, merge_by_embodiment(spark, merged)))
