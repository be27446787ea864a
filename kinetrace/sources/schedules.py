"""An endless, resumable schedule of shards as a streaming data source."""

from __future__ import annotations

import bisect
import hashlib
import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .storage import filesystem


def _hash(seed: int, *key) -> int:
    """What ``sharding.portable_hash`` gives."""
    return int(hashlib.md5(":".join(map(str, (seed, *key))).encode()).hexdigest()[:12], 16)


def draws(datasets: Sequence[tuple[str, float, float, int]], seed: int, first: int, last: int) -> Iterator[tuple[int, str, int, int]]:
    """(draw, dataset, cycle, shard) of the draws from ``first`` to ``last``, the latter not included, as ``sharding.schedule`` has them.

    datasets: (dataset, weight, mean_length, shards).  Which turn of its dataset a draw takes depends on those before it in
    the epoch, so these are drawn again; decks are made only for cycles that are asked for.
    """
    rows = sorted(datasets)
    p = [weight / mean for _, weight, mean, _ in rows]
    if not rows or min(p) < 0 or sum(p) <= 0:
        raise ValueError("weights must be 0 or more with a sum above 0")
    ends, at = [], 0.0
    for x in p:
        at += x / sum(p)
        ends.append(at)
    taken, decks = [0] * len(rows), {}
    for draw in range(last):
        i = min(bisect.bisect_right(ends, (_hash(seed, draw) + 0.5) / (1 << 48)), len(rows) - 1)
        name, _, _, shards = rows[i]
        cycle, turn = divmod(taken[i], shards)
        taken[i] += 1
        if draw >= first:
            if (i, cycle) not in decks:
                decks = {k: v for k, v in decks.items() if k[0] != i} | {(i, cycle): sorted(range(shards), key=lambda s: (_hash(seed + 1, name, cycle, s), s))}
            yield draw, name, cycle, decks[i, cycle][turn]


class _Stretch(InputPartition):
    def __init__(self, epoch: int, first: int, last: int):
        super().__init__((epoch, first))
        self.epoch, self.first, self.last = epoch, first, last


class ScheduleReader(DataSourceStreamReader):
    """Offsets are (epoch, draw).  How far draws are planned is kept in the file ``progress``, since Spark doesn't tell a source
    that starts again where its query stands; it is never ahead of the query's own log."""

    def __init__(self, options: dict):
        self.datasets = [tuple(d) for d in json.loads(options["datasets"])]
        self.seed, self.per_epoch, self.batch = int(options.get("seed", 0)), int(options["drawsPerEpoch"]), int(options.get("batch", 1000))
        self.parts, self.progress = int(options.get("partitions", 1)), options["progress"]
        if self.per_epoch < 1 or self.batch < 1 or self.parts < 1:
            raise ValueError("drawsPerEpoch, batch and partitions must be 1 or more")
        self.planned = self._kept()

    def _kept(self) -> int:
        fs, path = filesystem(self.progress)
        if not fs.get_file_info(path).is_file:
            return 0
        with fs.open_input_stream(path) as f:
            return self._number(json.loads(f.read()))

    def _number(self, offset: dict) -> int:
        return offset["epoch"] * self.per_epoch + offset["draw"]

    def _offset(self, number: int) -> dict:
        return dict(zip(("epoch", "draw"), divmod(number, self.per_epoch), strict=True))

    def initialOffset(self) -> dict:
        return self._offset(0)

    def latestOffset(self) -> dict:
        return self._offset(self.planned + self.batch)

    def partitions(self, start: dict, end: dict) -> list[_Stretch]:
        a, b = self._number(start), self._number(end)
        if b > self.planned:
            self.planned = b
            fs, path = filesystem(self.progress)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(path) as f:
                f.write(json.dumps(end).encode())
        size = max(1, -(-(b - a) // self.parts))
        out = []
        while a < b:
            epoch, first = divmod(a, self.per_epoch)
            n = min(size, b - a, self.per_epoch - first)
            out.append(_Stretch(epoch, first, first + n))
            a += n
        return out

    def read(self, partition: _Stretch) -> Iterator[tuple]:
        for draw, name, cycle, shard in draws(self.datasets, self.seed + partition.epoch, partition.first, partition.last):
            yield partition.epoch, draw, name, cycle, shard

    def commit(self, end: dict) -> None:
        """Nothing is held back for earlier draws: any of them can be drawn again."""


class ScheduleSource(DataSource):
    """format("shard_schedule"): an epoch's draws are those of seed + epoch, epochs follow one another without end.

    Options: datasets (JSON rows of dataset, weight, mean_length, shards), drawsPerEpoch, seed, batch (draws of a micro-batch),
    partitions (tasks of a micro-batch) and progress (a file beside the query's checkpoint).
    """

    @classmethod
    def name(cls) -> str:
        return "shard_schedule"

    def schema(self) -> str:
        return "epoch int, draw long, dataset string, cycle int, shard int"

    def streamReader(self, schema) -> ScheduleReader:
        return ScheduleReader(self.options)


def endless(spark: SparkSession, datasets: DataFrame, progress: str, *, draws_per_epoch: int, seed: int = 0, batch: int = 1000, partitions: int = 1) -> DataFrame:
    """The stream of draws (epoch, draw, dataset, cycle, shard) over a table of datasets, one row each (dataset, weight,
    mean_length, shards).  A query that is stopped and started again with its checkpoint goes on where it was."""
    spark.dataSource.register(ScheduleSource)
    rows = [[r.dataset, float(r.weight), float(r.mean_length), int(r.shards)] for r in datasets.select("dataset", "weight", "mean_length", "shards").collect()]
    options = {"datasets": json.dumps(rows), "drawsPerEpoch": draws_per_epoch, "seed": seed, "batch": batch, "partitions": partitions, "progress": progress}
    return spark.readStream.format("shard_schedule").options(**options).load()
