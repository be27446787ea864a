"""A Spark data source whose partitions are shards: one folder a shard, as write_shards lays them out."""

from __future__ import annotations

import re

import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .storage import filesystem


class ShardPartition(InputPartition):
    def __init__(self, shard: int, path: str):
        super().__init__(shard)
        self.shard, self.path = shard, path


class ShardReader(DataSourceReader):
    def __init__(self, path: str, schema, only: list[int] | None):
        self.path, self.schema, self.only = path, schema, only

    def partitions(self):
        """A partition for each shard folder; listing them is all that the driver does."""
        fs, root = filesystem(self.path)
        found = []
        for info in fs.get_file_info(pafs.FileSelector(root)):
            m = re.fullmatch(r"shard=(\d+)", info.base_name)
            if m and (self.only is None or int(m[1]) in self.only):
                found.append(ShardPartition(int(m[1]), f"{self.path.rstrip('/')}/{info.base_name}"))
        return sorted(found, key=lambda p: p.shard)

    def read(self, partition):
        import pyarrow as pa

        fs, folder = filesystem(partition.path)
        names = [f.name for f in self.schema.fields if f.name != "shard"]
        for batch in ds.dataset(folder, filesystem=fs, format="parquet").to_batches(columns=names):
            if batch.num_rows:
                columns = {n: batch.column(n) for n in names} | {"shard": pa.array([partition.shard] * batch.num_rows, pa.int32())}
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in self.schema.fields], names=[f.name for f in self.schema.fields])


class ShardSource(DataSource):
    """format("trajectory_shards") with options path and, to read some only, shards (1,4,7)."""

    @classmethod
    def name(cls) -> str:
        return "trajectory_shards"

    def schema(self) -> str:
        raise ValueError("give the schema of the shards")

    def reader(self, schema) -> ShardReader:
        only = self.options.get("shards")
        return ShardReader(self.options["path"], schema, [int(x) for x in only.split(",")] if only else None)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShardSource)


def shard_lengths(spark: SparkSession, path: str):
    """shard, length of each shard folder."""
    return spark.read.parquet(path).groupBy("shard").count().withColumnRenamed("count", "length")
