"""Experiment configurations: datasets, tags and mix ratios from YAML or JSON, checked."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import SparkSession

from kinetrace.schema import MixtureConfig


@dataclass
class DatasetConfig:
    """Paths of one group, its embodiment tag and its share of the mixture."""

    paths: list[str] = field(default_factory=list)
    tag: str = "new_embodiment"
    mix_ratio: float = 1.0
    include_splits: list[str] = field(default_factory=list)
    exclude_splits: list[str] = field(default_factory=list)


@dataclass
class ExperimentConfig:
    datasets: list[DatasetConfig] = field(default_factory=list)
    shard_size: int = 1024
    sampling_rate: float = 0.1
    shards_per_epoch: int = 100_000
    seed: int = 42
    eval_strategy: str = "no"

    def validate(self) -> ExperimentConfig:
        MixtureConfig([(p, d.tag, d.mix_ratio) for d in self.datasets for p in d.paths]).validate()
        if self.eval_strategy != "no":
            raise ValueError("mixtures are not evaluated while training")
        if self.shard_size < 1 or not 0 < self.sampling_rate <= 1:
            raise ValueError("shards need a size and a sampling rate in (0, 1]")
        return self

    def mixture(self) -> MixtureConfig:
        return MixtureConfig([(p, d.tag, d.mix_ratio) for d in self.datasets for p in d.paths])


def _made(kind, values: dict):
    """A dataclass from a mapping; names that it doesn't know are an error."""
    unknown = sorted(set(values) - {f.name for f in fields(kind)})
    if unknown:
        raise ValueError(f"{kind.__name__} has no {unknown}")
    return kind(**values)


def from_dict(values: dict) -> ExperimentConfig:
    own = dict(values)
    own["datasets"] = [_made(DatasetConfig, d) if isinstance(d, dict) else d for d in own.get("datasets", [])]
    return _made(ExperimentConfig, own)


def parse(text: str, name: str = ".json") -> ExperimentConfig:
    """JSON, or YAML where a YAML reader is installed."""
    if name.endswith(".json"):
        return from_dict(json.loads(text))
    try:
        import yaml
    except ImportError as e:
        raise ValueError("reading YAML needs a YAML reader; give JSON instead") from e
    data = yaml.safe_load(text)
    if not isinstance(data, dict):
        raise ValueError(f"{name} holds no configuration")
    return from_dict(data)


def load(spark: SparkSession, path: str) -> ExperimentConfig:
    return parse(spark.read.text(path, wholetext=True).first()[0], path)


def dumps(config: ExperimentConfig) -> str:
    return json.dumps(asdict(config), indent=4)
