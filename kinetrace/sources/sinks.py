"""Writers of datasets, statistics and converted layouts."""

from __future__ import annotations

import dataclasses
import enum
import json
from collections.abc import Sequence

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .episodes import EpisodeSink
from .lerobot import RELATIVE, STATS, read_json
from .storage import filesystem


def plain(value):
    """A value as JSON can hold it."""
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return {f.name: plain(getattr(value, f.name)) for f in dataclasses.fields(value)}
    if isinstance(value, enum.Enum):
        return value.name
    if isinstance(value, dict):
        return {str(plain(k)): plain(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return sorted(plain(v) for v in value)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def write_json(spark: SparkSession, value, path: str) -> None:
    """One JSON file, indent 4, through Hadoop's file systems."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(json.dumps(plain(value), indent=4).encode()))
    out.close()


def write_stats(spark: SparkSession, root: str, stats: dict) -> None:
    write_json(spark, stats, f"{root}/{STATS}")


def write_relative_stats(spark: SparkSession, root: str, stats: dict, overwrite: Sequence[str] = ()) -> None:
    """Keys that the file has already stay, unless they are to be overwritten."""
    old = read_json(spark, f"{root}/{RELATIVE}") or {}
    write_json(spark, {**stats, **{k: v for k, v in old.items() if k not in overwrite}}, f"{root}/{RELATIVE}")


def write_temporal_stats(spark: SparkSession, path: str, stats: dict, dataset: str | None = None) -> None:
    """A file of one dataset, or with a name, its entry in a consolidated file."""
    if not path.endswith(".json"):
        raise ValueError("temporal statistics go to a .json file")
    write_json(spark, stats if dataset is None else {**(read_json(spark, path) or {}), dataset: stats}, path)


def write_episode_files(frames: DataFrame, root: str, chunks_size: int = 1000) -> int:
    """data/chunk-000/episode_000000.parquet and so on: one file an episode, in order of frames; returns their number.

    Executors stream episodes into files of their attempt, so an episode may be longer than memory; all files appear at once
    when the job commits, or none.  A root that holds data already is an error.
    """
    spark = frames.sparkSession
    spark.dataSource.register(EpisodeSink)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = frames.repartition(parts, "episode_index").sortWithinPartitions("episode_index", "frame_index")
    dealt.write.format("trajectory_episodes").option("path", root).option("chunks_size", chunks_size).mode("append").save()
    fs, base = filesystem(root)
    # A folder's entries at a time.
    folders = fs.get_file_info(pafs.FileSelector(f"{base.rstrip('/')}/data"))
    return sum(sum(f.is_file for f in fs.get_file_info(pafs.FileSelector(folder.path))) for folder in folders)


def write_dataset(frames: DataFrame, episodes: DataFrame, tasks: DataFrame, info: dict, modality: dict, root: str) -> None:
    """A file per episode, episode and task lines, and both declarations; the file that makes it a dataset comes last."""
    spark = frames.sparkSession
    write_episode_files(frames, root, int(info.get("chunks_size", 1000)))
    write_lines(episodes, f"{root}/meta/episodes.jsonl", "episode_index")
    write_lines(tasks, f"{root}/meta/tasks.jsonl", "task_index")
    write_json(spark, modality, f"{root}/meta/modality.json")
    write_json(spark, info, f"{root}/meta/info.json")


def write_lines(df: DataFrame, path: str, order: str) -> None:
    """One file of JSON lines in order.  The rows pass through one task, as the format's single file asks for: episode and
    task tables, a line each."""
    spark = df.sparkSession
    jvm = spark._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    temp = f"{path}._lines"
    df.orderBy(order).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(temp)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [f.getPath() for f in fs.listStatus(at(temp)) if f.getPath().getName().startswith("part-")]
    fs.delete(at(path), True)
    if parts:
        fs.rename(parts[0], at(path))
    else:
        fs.create(at(path), True).close()
    fs.delete(at(temp), True)


def tasks_to_lines(spark: SparkSession, parquet: str, path: str) -> None:
    """A Parquet table of tasks as JSON lines, by task_index."""
    table = spark.read.parquet(parquet)
    text = next(c for c in ("task", "__index_level_0__", *table.columns) if c in table.columns and c != "task_index")
    write_lines(table.select("task_index", F.col(f"`{text}`").alias("task")), path, "task_index")


def legacy_episodes(episodes: DataFrame) -> DataFrame:
    """Episode lines of the older layout: no data/, videos/, stats/ or meta/ columns; length derived if missing."""
    kept = [c for c in episodes.columns if not c.startswith(("data/", "videos/", "stats/", "meta/"))]
    out = episodes
    if "length" not in kept:
        out, kept = out.withColumn("length", F.col("dataset_to_index") - F.col("dataset_from_index")), [*kept, "length"]
    return out.select(*[F.col(f"`{c}`") for c in kept])


def episode_stats(episodes: DataFrame) -> DataFrame:
    """stats/a/b columns to episode_index, feature, stat, value (as JSON text)."""
    names = [c for c in episodes.columns if c.startswith("stats/")]
    rows = F.array(*[F.struct(F.lit(c.split("/")[1]).alias("feature"), F.lit(c.split("/", 2)[2]).alias("stat"), F.to_json(F.array(F.col(f"`{c}`"))).alias("value")) for c in names])
    return episodes.select("episode_index", F.explode(rows).alias("r")).select("episode_index", "r.*")


def legacy_info(info: dict, totals: dict, version: str = "v2.1") -> dict:
    """info.json rewritten: version, patterns and totals; per-feature fps goes."""
    if info.get("codebase_version") != "v3.0":
        raise ValueError(f"a dataset of version {info.get('codebase_version')}, not v3.0")
    out = {k: v for k, v in info.items() if k not in ("data_files_size_in_mb", "video_files_size_in_mb")}
    out["features"] = {k: {a: b for a, b in v.items() if a != "fps"} for k, v in info.get("features", {}).items()}
    # Path patterns of the older layout.
    out |= {"codebase_version": version, "data_path": "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet", "video_path": "videos/chunk-{episode_chunk:03d}/{video_key}/episode_{episode_index:06d}.mp4"}
    return out | totals


def segment_plan(episodes: DataFrame, camera: str) -> DataFrame:
    """Which stretch of which file holds an episode's video; times must ascend, within a day, an hour at most."""
    a, b = F.col(f"`videos/{camera}/from_timestamp`"), F.col(f"`videos/{camera}/to_timestamp`")
    fine = (a >= 0) & (b > a) & (b <= 86400) & (b - a <= 3600)
    return episodes.select("episode_index", F.when(fine, a).otherwise(F.raise_error(F.lit("a segment's times are out of range"))).alias("from_s"), b.alias("to_s"))


def add_columns(df: DataFrame, path: str, new_path: str, **columns) -> DataFrame:
    """Rewrites a table with more columns to a new path; Spark can't overwrite what it reads."""
    if path.rstrip("/") == new_path.rstrip("/"):
        raise ValueError("write to another path, then swap")
    df.withColumns(columns).write.mode("overwrite").parquet(new_path)
    return df.sparkSession.read.parquet(new_path)


def sample_dataset(frames: DataFrame, episodes: DataFrame, tasks: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first n episodes with their frames and the tasks that these refer to."""
    own = episodes.orderBy("episode_index").limit(n)
    kept = frames.join(own.select("episode_index"), "episode_index", "left_semi")
    return kept, own, tasks.join(kept.select("task_index").distinct(), "task_index", "left_semi")


def rebuilt_vectors(frames: DataFrame, parts: Sequence[str], euler: str, correction: list[float], name: str) -> DataFrame:
    """Adds a vector of translation, corrected rot6d rows and further parts: the 17 values of a rebuilt robot state."""
    from kinetrace.functions.rotations import rot6d_rows_corrected
    from kinetrace.operators.vectors import as_vector

    first, *rest = parts
    return frames.withColumn(name, F.concat(as_vector(frames, first), rot6d_rows_corrected(F.col(f"`{euler}`"), correction), *[as_vector(frames, p) for p in rest]))


def check_sample(stats: dict, features: Sequence[str]) -> None:
    """A sample's statistics must have every feature that its frames have."""
    missing = sorted(set(features) - set(stats))
    if missing:
        raise ValueError(f"statistics lack {missing}")


def save_processor(spark: SparkSession, folder: str, config, statistics: dict, embodiments: dict[str, int]) -> None:
    for name, value in (("processor_config", config), ("statistics", statistics), ("embodiment_id", embodiments)):
        write_json(spark, value, f"{folder}/{name}.json")


def load_processor(spark: SparkSession, folder: str) -> tuple[dict, dict, dict]:
    return tuple(read_json(spark, f"{folder}/{name}.json") for name in ("processor_config", "statistics", "embodiment_id"))
