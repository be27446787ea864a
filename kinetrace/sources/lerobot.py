"""LeRobot-style dataset directories as lazy DataFrames."""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from kinetrace.operators.filters import check_frames
from kinetrace.operators.vectors import select_slices
from kinetrace.schema import Slice

from .storage import filesystem

EPISODES = "episode_index long, tasks array<string>, length long, sub_tasks array<struct<start: long, end: long, text: string>>"
TASKS = "task_index long, task string"
#: File names of the layout.
INFO, EPISODES_FILE, TASKS_FILE, MODALITY, STATS, RELATIVE, TEMPORAL = ("meta/info.json", "meta/episodes.jsonl", "meta/tasks.jsonl", "meta/modality.json", "meta/stats.json", "meta/relative_stats.json", "meta/temporal_stats.json")


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A whole JSON file through Spark's readers, so any store will do; None if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


#: Frames of an episode that are asked for together; rows and bytes up to which those of small files go on together.
SPARSE_BLOCK, HELD_ROWS, HELD_BYTES = 4096, 4096, 16 << 20


def overlapping(metadata, frames: Sequence[int]) -> list[int]:
    """Row groups of a Parquet file that may hold some of the (ascending) frames; all that don't say what they hold."""
    names = [metadata.schema.column(i).path for i in range(metadata.num_columns)]
    at, out = names.index("frame_index"), []
    for g in range(metadata.num_row_groups):
        held = metadata.row_group(g).column(at).statistics
        if held is None or not held.has_min_max:
            out.append(g)
            continue
        i = bisect.bisect_left(frames, held.min)
        if i < len(frames) and frames[i] <= held.max:
            out.append(g)
    return out


def _together(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """Rows of small tables in batches; an episode alone is often too short to be sent for itself."""
    held, rows, size = [], 0, 0
    for table in tables:
        held.append(table)
        rows, size = rows + table.num_rows, size + table.nbytes
        if rows >= HELD_ROWS or size >= HELD_BYTES:
            yield from pa.concat_tables(held).combine_chunks().to_batches(max_chunksize=1024)
            held, rows, size = [], 0, 0
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches(max_chunksize=1024)


def _conformed(table: pa.Table | pa.RecordBatch, names: Sequence[str], schema: pa.Schema, episode: Callable[[], int]) -> pa.Table:
    """The named columns in the types of schema: episode_index is added where it is missing, others are null there."""
    out = []
    for name, field in zip(names, schema, strict=True):
        at = table.schema.get_field_index(name)
        if at >= 0:
            own = table.column(at)
            out.append(own if own.type == field.type else own.cast(field.type))
        else:
            out.append(pa.repeat(pa.scalar(episode(), field.type), table.num_rows) if name == "episode_index" else pa.nulls(table.num_rows, field.type))
    return pa.Table.from_arrays(out, schema=schema)


def _read_frames(names: list[str], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of units (path, episode_index, frames), sorted by path, the rows of those frames."""

    def tables(batches):
        opened, source, file = None, None, None
        for batch in batches:
            for path, episode, frames in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if path != opened:
                    if source is not None:
                        source.close()
                    fs, bare = filesystem(path)
                    source = fs.open_input_file(bare)
                    opened, file = path, pq.ParquetFile(source)
                there, found = [n for n in names if n in file.schema_arrow.names], set()
                for g in overlapping(file.metadata, frames):
                    table = file.read_row_group(g, columns=list(dict.fromkeys([*there, "frame_index"])), use_threads=False)
                    table = table.filter(pc.is_in(table["frame_index"], pa.array(frames, table["frame_index"].type)))
                    found.update(table["frame_index"].to_pylist())
                    yield _conformed(table, names, schema, lambda episode=episode: episode)
                if missing := sorted(set(frames) - found):
                    raise ValueError(f"{path} lacks the frames {missing[:5]}, which its episode's length promises")
        if source is not None:
            source.close()

    return lambda batches: _together(tables(batches))


def _parquet_names(fs: pafs.FileSystem, folder: str) -> list[str]:
    return sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(folder)) if f.is_file and f.extension == "parquet" and f.base_name[0] not in "._")


def _files_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The Parquet files of folders."""
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            fs, bare = filesystem(folder)
            yield pa.record_batch([pa.array([f"{folder}/{n}" for n in _parquet_names(fs, bare)], pa.string())], ["path"])


def _number(path: str) -> int:
    """The episode that a file's name says."""
    found = re.search(r"episode_(\d+)\.parquet", path)
    if not found:
        raise ValueError(f"neither {path} nor its name says which episode it holds")
    return int(found[1])


def _read_files(names: list[str], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows of files (path)."""

    def tables(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, bare = filesystem(path)
                with fs.open_input_file(bare) as source, pq.ParquetFile(source) as file:
                    there = [n for n in names if n in file.schema_arrow.names]
                    for part in file.iter_batches(batch_size=1024, columns=there, use_threads=False):
                        yield _conformed(part, names, schema, lambda path=path: _number(path))

    return lambda batches: _together(tables(batches))


def _plain(fields: StructType) -> StructType:
    """Arrow functions of Spark don't take dots in column names."""
    return StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])


class TrajectoryDataset:
    """A dataset directory: metadata on the driver, frames and episodes as DataFrames."""

    def __init__(self, spark: SparkSession, root: str, need_stats: bool = False):
        self.spark, self.root = spark, root.rstrip("/")
        self.info = read_json(spark, f"{self.root}/{INFO}")
        if self.info is None:
            raise FileNotFoundError(f"{self.root}/{INFO}")
        self.modality = read_json(spark, f"{self.root}/{MODALITY}") or {}
        self.stats, self.relative_stats, self.temporal_stats = (read_json(spark, f"{self.root}/{f}") for f in (STATS, RELATIVE, TEMPORAL))
        if need_stats and self.stats is None:
            raise FileNotFoundError(f"{self.root}/{STATS}")
        self._fields: StructType | None = None

    def reread(self, need_stats: bool = False) -> TrajectoryDataset:
        """The same dataset with metadata as they are now; its files, published as a whole, keep their columns."""
        out = TrajectoryDataset(self.spark, self.root, need_stats)
        out._fields = self._fields
        return out

    @property
    def episodes(self) -> DataFrame:
        return self.spark.read.schema(EPISODES).json(f"{self.root}/{EPISODES_FILE}")

    @property
    def tasks(self) -> DataFrame:
        return self.spark.read.schema(TASKS).json(f"{self.root}/{TASKS_FILE}")

    @property
    def features(self) -> DataFrame:
        rows = [(k, v.get("dtype"), [int(x) for x in v.get("shape") or []]) for k, v in self.info.get("features", {}).items()]
        return self.spark.createDataFrame(rows, "name string, dtype string, shape array<int>")

    def episode_path(self, episode: int) -> str:
        chunk = episode // int(self.info.get("chunks_size", 1000))
        return f"{self.root}/" + self.info["data_path"].format(episode_chunk=chunk, episode_index=episode)

    def frames(self, episodes: Sequence[int] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """All frames, or those of some episodes, read file by file, with all columns or some; episode_index comes from the
        file name if need be.

        The driver lists folders only: files, one an episode, are listed by tasks, dealt out and read there, so neither the
        driver's memory nor a plan grows by an entry a file.  Columns are those of the first file; a file that lacks one has
        nulls.  Stores that only Spark's readers can open are listed by these, a folder a task.
        """
        own = lambda df: df if columns is None else df.select(*[F.col(f"`{c}`") for c in self._wanted(df.columns, columns)])
        if episodes is not None:
            return own(self._indexed(self.spark.read.parquet(*[self.episode_path(e) for e in episodes])))
        try:
            fs, bare = filesystem(f"{self.root}/data")
        except pa.ArrowInvalid:
            return own(self._indexed(self.spark.read.option("pathGlobFilter", "*.parquet").parquet(f"{self.root}/data/*")))
        folders = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(bare)) if f.type == pafs.FileType.Directory and f.base_name[0] not in "._")
        if self._fields is None:
            first = next((names[0] for f in folders if (names := _parquet_names(fs, f"{bare}/{f}"))), None)
            if first is None:
                raise FileNotFoundError(f"{self.root}/data holds no frames")
            fields = self.spark.read.parquet(f"{self.root}/data/*/{first}").schema
            self._fields = fields if "episode_index" in fields.names else fields.add("episode_index", "long")
        names = self._fields.names if columns is None else self._wanted(self._fields.names, columns)
        fields = StructType([self._fields[n] for n in names])
        # Of rows that come from Python Spark expects any size, so it never takes frames for a table to be broadcast.
        listed = self.spark.createDataFrame(self.spark.sparkContext.parallelize([(f"{self.root}/data/{f}",) for f in folders]), "path string")
        paths = listed.mapInArrow(_files_of, "path string").repartition(self._parts(), "path")
        plain = _plain(fields)
        return paths.mapInArrow(_read_files(names, to_arrow_schema(plain)), plain).toDF(*names)

    @staticmethod
    def _wanted(names: Sequence[str], columns: Sequence[str]) -> list[str]:
        """Of a file's columns those asked for, and the two that say which frame it is."""
        return [n for n in names if n in {"episode_index", "frame_index", *columns}]

    def _parts(self) -> int:
        return max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    @staticmethod
    def _indexed(df: DataFrame) -> DataFrame:
        if "episode_index" not in df.columns:
            df = df.withColumn("episode_index", F.regexp_extract(F.col("_metadata.file_path"), r"episode_(\d+)\.parquet", 1).cast("long"))
        return df

    def bounded_frames(self, episodes: Sequence[int] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """Frames below their episode's nominal length, with the episode's tasks and sub-tasks."""
        own = self.episodes.withColumnRenamed("episode_index", "e_")
        return self.frames(episodes, columns).join(own, F.col("episode_index") == F.col("e_")).where(F.col("frame_index") < F.col("length")).drop("e_")

    def slices(self, modality: str) -> dict[str, Slice]:
        return {k: Slice(int(v.get("start", 0)), int(v.get("end", 0)), v.get("original_key"), tuple(v.get("original_keys") or ()), bool(v.get("is_text", False))) for k, v in self.modality.get(modality, {}).items()}

    def load(self, modalities: Sequence[str] = ("state", "action"), episodes: Sequence[int] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """Frames with state.* and action.* slices, and all columns that files have, or beside what slices are cut from some."""
        defaults = {"state": "observation.state", "action": "action"}
        if columns is not None:
            columns = [*columns, *(c for m, d in defaults.items() if m in modalities for s in self.slices(m).values() for c in s.original_keys or (s.original_key or d,))]
        df = self.bounded_frames(episodes, columns)
        for name, default in defaults.items():
            if name in modalities and self.modality.get(name):
                df = select_slices(df, self.slices(name), default, name)
        return df

    def sparse(self, needed: DataFrame, clamp: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
        """Only the (episode_index, frame_index) that are needed, with all columns or some, and the episode's tasks; a frame
        outside its episode is an error, or with ``clamp`` the one next to it.

        Nothing but what is asked for is opened: lengths are those of the metadata, wanted frames become files and ranges of
        frames, and executors read of each file the row groups that the ranges meet.  A file is one task's; an episode's
        frames are asked for in blocks, so a list of them is bounded.
        """
        wanted = check_frames(needed.select("episode_index", "frame_index").distinct(), self.lengths(), "episode_index", "frame_index", clamp=clamp)
        block = F.floor(F.col("frame_index") / SPARSE_BLOCK).alias("block")
        units = wanted.groupBy("episode_index", block).agg(F.sort_array(F.collect_set("frame_index")).alias("frames"))
        units = units.withColumn("path", self._path(self.info["data_path"], F.col("episode_index"), ""))
        fields = self._frame_schema()
        if columns is not None:
            names = dict.fromkeys(["episode_index", "frame_index", *columns])
            fields = StructType([f for f in fields if f.name in names])
        dealt = units.repartition(self._parts(), "path").sortWithinPartitions("path", "block").select("path", "episode_index", "frames")
        plain = _plain(fields)
        rows = dealt.mapInArrow(_read_frames(fields.names, to_arrow_schema(plain)), plain).toDF(*fields.names)
        own = self.episodes.withColumnRenamed("episode_index", "e_")
        return rows.join(own, F.col("episode_index") == F.col("e_")).drop("e_")

    def _frame_schema(self) -> StructType:
        """Of one file, that of an episode of the metadata; episode_index is added where files lack it."""
        first = self.episodes.select("episode_index").first()
        if first is None:
            raise ValueError(f"{self.root} has no episodes")
        fields = self.spark.read.parquet(self.episode_path(first[0])).schema
        return fields if "episode_index" in fields.names else fields.add("episode_index", "long")

    def shard_frames(self, plan: DataFrame, shard: int, offsets: Sequence[int], columns: Sequence[str] | None = None) -> DataFrame:
        """The frames that a shard's anchors (episode, frame, shard) see at some offsets, and no others; places beyond an
        episode's ends stand for its first and last frame."""
        anchors = plan.where(F.col("shard") == shard).select(F.col("episode").alias("episode_index"), F.col("frame").alias("frame_index"))
        seen = anchors.select("episode_index", F.explode(F.array(*[F.col("frame_index") + d for d in offsets])).alias("frame_index"))
        return self.sparse(seen, clamp=True, columns=columns)

    def lengths(self) -> DataFrame:
        return self.episodes.select("episode_index", "length")

    def files(self) -> DataFrame:
        """episode_index, chunk, path: where each episode's frames lie."""
        chunk = F.floor(F.col("episode_index") / int(self.info.get("chunks_size", 1000)))
        return self.episodes.select("episode_index", chunk.alias("chunk"), self._path(self.info["data_path"], F.col("episode_index"), "").alias("path"))

    def initial_actions(self, path: str = "meta/initial_actions") -> DataFrame | None:
        """trajectory, key, action (rows) of a Parquet table beside the metadata; None if there is none.  Never unpickled."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        there = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)
        return self.spark.read.parquet(f"{self.root}/{path}") if there else None

    def video_path(self, key: str, episode: Column) -> Column:
        original = self.modality.get("video", {}).get(key, {}).get("original_key") or f"observation.images.{key}"
        return self._path(self.info.get("video_path") or "", episode, original)

    def mask_path(self, key: str, episode: Column) -> Column:
        original = self.modality.get("mask", {}).get(key, {}).get("original_key") or key
        return self._path(self.info.get("mask_path") or "", episode, original)

    def _path(self, pattern: str, episode: Column, key: str) -> Column:
        """A Python format pattern as a Column."""
        chunk = F.floor(episode / int(self.info.get("chunks_size", 1000)))
        values = {"episode_chunk": chunk, "episode_index": episode}
        args, out = [], ""
        for text, name, width in re.findall(r"([^{]*)(?:\{(\w+)(?::0?(\d+)d)?\})?", pattern):
            out += text.replace("%", "%%")
            if name in values:
                args.append(values[name].cast("long"))
                out += f"%0{width}d" if width else "%d"
            elif name:
                out += key
        return F.concat(F.lit(f"{self.root}/"), F.format_string(out, *args) if args else F.lit(out))

    def totals(self) -> dict:
        n, frames = self.episodes.agg(F.count("*"), F.sum("length")).first()
        size = int(self.info.get("chunks_size", 1000))
        return {"total_episodes": n, "total_frames": frames or 0, "total_chunks": -(-n // size), "total_tasks": self.tasks.count()}


def map_cameras(declared: Sequence[str], present: Sequence[str]) -> dict[str, str]:
    """Declared camera keys to present ones: equal names first; if names differ and counts agree, by place."""
    if set(declared) <= set(present):
        return {k: k for k in declared}
    if len(declared) != len(present):
        raise ValueError(f"{len(declared)} cameras declared, {len(present)} present")
    return dict(zip(declared, present, strict=True))


def consolidated_episodes(spark: SparkSession, root: str) -> DataFrame:
    """Episode tables of the consolidated layout, in order."""
    return spark.read.parquet(f"{root}/meta/episodes/*/*.parquet").orderBy("episode_index")


def episodes_by_file(episodes: DataFrame, chunk: str = "data/chunk_index", file: str = "data/file_index") -> DataFrame:
    """chunk, file, episodes: which episodes each consolidated file holds, in order; a file holds a bounded number."""
    return episodes.groupBy(F.col(f"`{chunk}`").alias("chunk"), F.col(f"`{file}`").alias("file")).agg(F.sort_array(F.collect_list("episode_index")).alias("episodes"))


def union_of(datasets: dict[str, DataFrame], name: str = "dataset") -> DataFrame:
    """Rows of several datasets with the name of theirs; columns that some lack are null there."""
    out = None
    for key, df in datasets.items():
        own = df.withColumn(name, F.lit(key))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise ValueError("a union needs a dataset")
    return out
