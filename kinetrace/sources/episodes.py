"""A batch sink of one Parquet file an episode, published as a whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .storage import filesystem

#: Frames of a row group, the least that a sparse load reads of an episode.
ROW_GROUP = 4096


def file_name(episode: int) -> str:
    return f"episode_{episode:06d}.parquet"


@dataclass
class Written(WriterCommitMessage):
    """The folder of one task attempt that succeeded, and the episodes whose files lie there."""

    folder: str
    episodes: list[int]


class EpisodeWriter(DataSourceArrowWriter):
    """Tasks write episodes, sorted by their frames, under a folder of their attempt.  The commit gathers the files of attempts
    that succeeded and moves their folder in place by one rename; an abort, or a job that dies, leaves no data folder."""

    def __init__(self, options: dict, names: list[str]):
        self.root, self.size, self.names = options["path"].rstrip("/"), int(options.get("chunks_size", 1000)), names
        self.staging = f"{self.root}/_staging-{uuid.uuid4().hex}"
        fs, root = filesystem(self.root)
        if fs.get_file_info(f"{root}/data").type != pafs.FileType.NotFound:
            raise FileExistsError(f"{self.root} holds data already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, staging = filesystem(self.staging)
        folder = f"{staging}/{uuid.uuid4().hex}"
        at, out, file, episodes, seen, held, n = self.names.index("episode_index"), None, None, [], set(), [], 0

        def flush():
            nonlocal held, n
            if held:
                out.write_table(pa.Table.from_batches(held), row_group_size=ROW_GROUP)
            held, n = [], 0

        def close():
            if out is not None:
                flush()
                out.close()
                file.close()

        for batch in iterator:
            batch = pa.RecordBatch.from_arrays(batch.columns, names=self.names)
            if batch.column(at).null_count:
                raise ValueError("a frame without episode_index")
            # Rows are sorted by episode, so its stretch ends where a later one begins.
            numbers = batch.column(at).to_numpy()
            ends = [*(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)] if len(numbers) else []
            for start, end in zip([0, *ends], ends, strict=False):
                episode = int(numbers[start])
                if not episodes or episodes[-1] != episode:
                    close()
                    if episode in seen:
                        raise ValueError(f"frames of episode {episode} don't come together")
                    seen.add(episode)
                    if not episodes:
                        fs.create_dir(folder, recursive=True)
                    episodes.append(episode)
                    file = fs.open_output_stream(f"{folder}/{file_name(episode)}")
                    out = pq.ParquetWriter(file, batch.schema)
                held.append(batch.slice(start, end - start))
                n += end - start
                if n >= ROW_GROUP:
                    flush()
        close()
        return Written(folder, episodes)

    def commit(self, messages: list[Written | None]) -> None:
        moves: dict[int, list[tuple[str, int]]] = {}
        for m in messages:
            for episode in m.episodes if m is not None else ():
                moves.setdefault(episode // self.size, []).append((m.folder, episode))
        if any(len({e for _, e in own}) < len(own) for own in moves.values()):
            self.abort(messages)
            raise ValueError("an episode was written by two tasks: partition by episode_index")
        fs, staging = filesystem(self.staging)
        fs.create_dir(f"{staging}/data", recursive=True)

        def gather(chunk: int) -> None:
            target = f"{staging}/data/chunk-{chunk:03d}"
            fs.create_dir(target, recursive=True)
            for folder, episode in moves[chunk]:
                fs.move(f"{folder}/{file_name(episode)}", f"{target}/{file_name(episode)}")

        # One unit a chunk, so what waits is as long as there are chunks, not files.
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(gather, moves))
        fs.move(f"{staging}/data", f"{filesystem(self.root)[1]}/data")
        fs.delete_dir(staging)

    def abort(self, messages: list[Written | None]) -> None:
        fs, staging = filesystem(self.staging)
        if fs.get_file_info(staging).type != pafs.FileType.NotFound:
            fs.delete_dir(staging)


class EpisodeSink(DataSource):
    """format("trajectory_episodes") with options path and chunks_size; write it partitioned by episode_index and sorted."""

    @classmethod
    def name(cls) -> str:
        return "trajectory_episodes"

    def writer(self, schema, overwrite: bool) -> EpisodeWriter:
        return EpisodeWriter(self.options, schema.names)
