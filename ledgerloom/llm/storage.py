"""Folders and tables that every executor can reach."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="ledgerloom-llm-")


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below spark.checkpoint.dir.

    A session that runs in one process may leave the setting out and gets a
    local folder; every cluster, a local one of several processes included,
    must name a shared folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = _local_root()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of `df`, written once as Parquet and read back from there.

    It cuts the lineage as a reliable checkpoint does, so rows whose order or
    file names were decided once stay as they are when executors are lost.
    """
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it, for use in tasks."""
    return fs.FileSystem.from_uri(path)


def has(df: DataFrame) -> bool:
    """Whether there are rows."""
    return not df.isEmpty()
