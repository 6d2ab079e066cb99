"""Session settings the library is written for, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    # Billing dates are UTC dates; a local zone would move midnight.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key may hold a third of the rows: let AQE split its partition,
    # also where that costs a further shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
}

# For terabytes: shuffle partitions of this size, to which AQE merges smaller
# ones, so that none outgrows the memory of a task.
SHUFFLE_PARTITION_BYTES = 128 << 20
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(SHUFFLE_PARTITION_BYTES),
    "spark.sql.files.maxPartitionBytes": "256m",
}


def build_session(
    app_name: str = "ledgerloom", master: str | None = None, shuffle_bytes: int | None = None, **settings
) -> SparkSession:
    """A session with the library's settings; `settings` use __ for dots in names.

    On a cluster give `shuffle_bytes`, the size of the largest shuffle, at most
    that of the input: shuffles start with as many partitions of 128 MB.
    """
    cluster = {}
    if shuffle_bytes is not None:
        partitions = max(200, -(-shuffle_bytes // SHUFFLE_PARTITION_BYTES))
        initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
        cluster = {**CLUSTER_SETTINGS, initial: str(partitions), "spark.sql.shuffle.partitions": str(partitions)}
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    extra = {name.replace("__", "."): str(value) for name, value in settings.items()}
    for name, value in {**SETTINGS, **cluster, **extra}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def runs_in_one_process(spark: SparkSession) -> bool:
    """True for local[...] masters; local-cluster[...] has executors of its own."""
    return spark.sparkContext.master.split("[")[0] == "local"


def scratch_dir(spark: SparkSession, purpose: str, local_root: str | None = None) -> str:
    """A new folder path that every executor can reach, below spark.checkpoint.dir.

    Without that setting a session in one process may name a folder of its own,
    `local_root`; a cluster is refused, as its executors could not see each
    other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and local_root and runs_in_one_process(spark):
        root = local_root
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers of an application import this package, wherever the driver was started.

    The package goes to the executors as a zip archive, once per application.
    Not needed where it is installed on every machine.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="ledgerloom-package-"), "ledgerloom.zip")
    with zipfile.ZipFile(archive, "w") as kept:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    kept.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)
