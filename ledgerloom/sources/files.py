"""File sources: typed CSV, merged Parquet, folders of files, image batches."""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT_COLUMN = "_corrupt_record"


def csv_options(sep: str = ",", quote: str = '"', escape: str = "\\", recursive: bool = True) -> dict:
    return {
        "header": True,
        "sep": sep,
        "quote": quote,
        "escape": escape,
        "recursiveFileLookup": recursive,
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT_COLUMN,
    }


def infer_csv_schema(spark: SparkSession, path: str | list[str], **dialect) -> T.StructType:
    """Column names from the header, types from one pass over the values."""
    return spark.read.options(**csv_options(**dialect)).option("inferSchema", True).csv(path).schema


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    corrupt_column: bool = False,
    **dialect,
) -> DataFrame:
    """CSV with header. Types come from `schema`, or from the data without one.

    With `corrupt_column` a line that does not fit the schema is kept whole in
    `_corrupt_record`, which is NULL for all others. Spark only parses the
    columns a query uses, so store the frame before filtering on that column.
    """
    schema = schema or infer_csv_schema(spark, path, **dialect)
    if corrupt_column and CORRUPT_COLUMN not in schema.names:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT_COLUMN, T.StringType())])
    return spark.read.options(**csv_options(**dialect)).schema(schema).csv(path)


def read_merged_parquet(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files under a path, with the union of their columns and path partitions."""
    return spark.read.option("mergeSchema", True).parquet(path)


def read_directory(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """The files of a folder as (path, modificationTime, length, content).

    The content is only read where a query uses the column.
    """
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", recursive)
        .load(path)
    )


# Marks in the file names of image batches.
TRAIN_BATCH_MARK = "data_batch"
TEST_BATCH_MARK = "test_batch"

_BATCH_SCHEMA = "split string, path string, position long, pixels array<smallint>, label int"
_ROWS_PER_ARROW_BATCH = 1000


class _ArraysOnly(pickle.Unpickler):
    """Unpickles containers and numpy arrays; any other class is refused."""

    def find_class(self, module, name):
        if module.split(".")[0] == "numpy" and name in {"_reconstruct", "ndarray", "dtype", "_frombuffer", "scalar"}:
            return super().find_class(module, name)
        if (module, name) == ("_codecs", "encode"):
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed in an image batch")


def _unpickled_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for split, path, content in frame.itertuples(index=False):
            batch = _ArraysOnly(io.BytesIO(content), encoding="bytes").load()
            data, labels = batch[b"data"], batch[b"labels"]
            for start in range(0, len(data), _ROWS_PER_ARROW_BATCH):
                rows = data[start : start + _ROWS_PER_ARROW_BATCH]
                yield pd.DataFrame(
                    {
                        "split": split,
                        "path": path,
                        "position": range(start, start + len(rows)),
                        "pixels": list(rows.astype("int16")),
                        "label": [int(x) for x in labels[start : start + len(rows)]],
                    }
                )


def batch_files(files: DataFrame, part: int = -1) -> DataFrame:
    """The files (path, ...) that are image batches, with `split`: train or test by a mark in the name.

    The name is the last part of the path, or the one that `part` counts from its end.
    """
    name = F.element_at(F.split("path", "/"), part)
    split = F.when(name.contains(TRAIN_BATCH_MARK), "train").when(name.contains(TEST_BATCH_MARK), "test")
    return files.withColumn("split", split).where("split is not null")


def read_image_batches(spark: SparkSession, path: str) -> DataFrame:
    """Pickled image batches as (split, path, position, pixels, label).

    Files named *data_batch* are training data, *test_batch* test data; others
    are left out.
    """
    return decode_image_batches(read_directory(spark, path))


def decode_image_batches(files: DataFrame) -> DataFrame:
    """The images of a table of batch files (path, content).

    Each task decodes whole files and sends their rows on in pieces.
    """
    batches = batch_files(files).select("split", "path", "content")
    return batches.mapInPandas(_unpickled_rows, _BATCH_SCHEMA)
