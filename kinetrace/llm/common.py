"""Shared storage and sizing helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a written table is marked for broadcast; above it Spark's own rules and shuffles hold.
BROADCAST_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and the master is local, as in tests, a temporary folder is set as the checkpoint folder;
    executors elsewhere would write it to their own disks, so there the setting is asked for.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="kinetrace-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Rows of texts that Spark hands to a Python worker at once, unless the session sets its own number.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession) -> None:
    """Texts are long: with the default of 10,000 rows a batch, a worker's and the JVM's copies take hundreds of MB."""
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


class Workspace:
    """A folder of written tables in the shared directory: lineage ends there, so lost executors cost a reread only."""

    def __init__(self, spark: SparkSession, name: str):
        short_batches(spark)
        self.spark, self.path = spark, f"{shared_dir(spark)}/kinetrace/{name}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Removes tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def size_in_bytes(df: DataFrame) -> int:
    """Spark's estimate of df, which for a written table comes from the sizes of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """Marks a written table for broadcast if its files are within BROADCAST_BYTES."""
    return F.broadcast(df) if size_in_bytes(df) <= BROADCAST_BYTES else df


def filesystem(path: str):
    """pyarrow file system and bare path of a URI or local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
