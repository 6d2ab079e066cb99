"""Batch conversion that remembers the files it has read.

    data/run=<id>/              the converted rows, with the file each comes from
    ledger/run=<id>/            path, length and time of the files that run has read

A file is new if the ledger does not hold it with its length and time. The
ledger of a run is written after its rows and is what makes them count, so a
run that fails leaves nothing and its files are new again.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sinks.files import decoded_path, write_parquet
from ledgerloom.sources.files import read_csv, read_directory

_FILE = "path string, length bigint, modified timestamp"
_LEDGER = f"{_FILE}, number bigint, run string"
RUN, SOURCE = "run", "source_path"
# Characters of a path that its reader would take for a pattern.
_GLOB = re.compile(r"([\[\]{}*?\\,])")
# Files that one run converts; more of them make more runs.
FILES_PER_RUN = 10_000


@dataclass(frozen=True)
class Bookmark:
    """Where the rows and the ledger of one job lie."""

    root: str

    def folder(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def ledger(self, spark: SparkSession) -> DataFrame:
        """path, length, modified, number (of the run, from 0), run of every file that was read."""
        at = spark._jvm.org.apache.hadoop.fs.Path(self.folder("ledger"))
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.createDataFrame([], _LEDGER)
        return spark.read.schema(_LEDGER).parquet(self.folder("ledger"))

    def new_files(self, spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
        """path, length, modified of the files below a folder that the ledger does not hold as they are."""
        listed = read_directory(spark, folder, pattern).select("path", "length", F.col("modificationTime").alias("modified"))
        return listed.join(self.ledger(spark).select(*listed.columns), listed.columns, "left_anti")

    def rows(self, spark: SparkSession) -> DataFrame:
        """What the runs have converted, with `source_path` and `run`; of a file that was read again the last reading.

        Folders of runs that failed are left out by their names. What has to be
        looked up row by row is only the files that were read again.
        """
        ledger = self.ledger(spark)
        runs = ledger.select(RUN).distinct()
        last = ledger.groupBy("path").agg(F.max("number").alias("last"))
        stale = ledger.join(last, "path").where("number < last").select(F.col("path").alias(SOURCE), RUN)
        read = spark.read.parquet(self.folder("data")).join(runs, RUN, "left_semi")
        return read.join(stale, [SOURCE, RUN], "left_anti")


@dataclass(frozen=True)
class ConvertedRun:
    """One run: its name, how many files it read and how many rows it wrote."""

    run: str
    files: int
    rows: int


def _chunks(files: DataFrame, size: int) -> Iterator[list[T.Row]]:
    """The files in order of their paths, so many at a time."""
    chunk: list[T.Row] = []
    for row in files.sort("path").toLocalIterator(prefetchPartitions=True):
        chunk.append(row)
        if len(chunk) == size:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


def convert_new(
    spark: SparkSession,
    folder: str,
    bookmark: Bookmark,
    schema: T.StructType,
    pattern: str = "*.csv",
    files_per_run: int = FILES_PER_RUN,
    prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    **dialect,
) -> list[ConvertedRun]:
    """Convert the CSV files that are new since the last call, or were written anew, to Parquet; what was done.

    The driver holds the names of `files_per_run` files at most. One job per
    bookmark at a time. Files are read as their paths are listed; one that is
    rewritten while it is read counts as new the next time.
    """
    done: list[ConvertedRun] = []
    last = bookmark.ledger(spark).agg(F.max("number")).first()[0]
    number = 0 if last is None else last + 1
    for chunk in _chunks(bookmark.new_files(spark, folder, pattern), files_per_run):
        run = f"{number:08d}-{uuid.uuid4().hex[:12]}"
        rows = read_csv(spark, [_GLOB.sub(r"\\\1", f["path"]) for f in chunk], schema, **dialect)
        # The same form as in the listing.
        source = F.regexp_replace(decoded_path(F.col("_metadata.file_path")), "^file:///", "file:/")
        written = write_parquet(prepare(rows.withColumn(SOURCE, source)), bookmark.folder(f"data/{RUN}={run}"))
        noted = spark.createDataFrame([tuple(f) for f in chunk], _FILE).withColumn("number", F.lit(number).cast("bigint"))
        noted.coalesce(1).write.parquet(bookmark.folder(f"ledger/{RUN}={run}"))
        done.append(ConvertedRun(run, len(chunk), written))
        number += 1
    return done
