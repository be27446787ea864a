"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """kinetrace under spark.checkpoint.dir; only on a local master without it, a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="kinetrace-")
        spark.sparkContext.setCheckpointDir(path)
    return f"{path.rstrip('/')}/kinetrace"


def filesystem(path: str):
    """pyarrow file system and bare path of a URI or a local path."""
    return pafs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (pafs.LocalFileSystem(), path)
