"""Ingest of arriving CSV files with Structured Streaming.

The checkpoint remembers the files already read: a second run takes only new
ones. One query per checkpoint at a time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.sinks.files import dataset_name, decoded_path
from ledgerloom.sources.catalog import add_partition, register_table
from ledgerloom.sources.files import csv_options

# Fixed value: ending of the files that start an ingest.
SUFFIX = ".csv"


def arriving_csv(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    suffix: str = SUFFIX,
    files_per_batch: int | None = None,
    **dialect,
) -> DataFrame:
    """A stream of the rows of CSV files below a folder, with `source_key`, the file's path."""
    reader = spark.readStream.schema(schema).options(**csv_options(**dialect)).option("pathGlobFilter", f"*{suffix}")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(folder).select("*", decoded_path(F.col("_metadata.file_path")).alias("source_key"))


def ingest_stream(
    arrivals: DataFrame,
    output: str,
    checkpoint: str,
    when: dt.datetime | None = None,
    database: str | None = None,
    prefix: str = "",
) -> StreamingQuery:
    """Write arrived rows as Parquet and, with a `database`, keep a table over them.

    Handles all files present and stops. Each batch has its own folder
    run=<batch>, replaced if the batch is repeated after a failure, so no row is
    written twice. `dataset` names the input file and the time of the run.
    """

    folder = output.rstrip("/").rsplit("/", 1)[-1]

    def _catalogue(written: DataFrame, batch_id: int) -> None:
        spark, table = written.sparkSession, f"{database}.{prefix}{folder}"
        if spark.catalog.databaseExists(database) and spark.catalog.tableExists(table):
            add_partition(spark, table, written.schema, "run", batch_id)
        else:
            register_table(spark, output, database, prefix)

    def write(batch: DataFrame, batch_id: int) -> None:
        named = batch.withColumn("dataset", dataset_name(F.col("source_key"), when or F.current_timestamp()))
        named.write.mode("overwrite").parquet(f"{output.rstrip('/')}/run={batch_id}")
        if database:
            _catalogue(named, batch_id)

    return (
        arrivals.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
