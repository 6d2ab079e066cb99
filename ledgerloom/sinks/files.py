"""File sinks: CSV with and without header, Parquet with a row count, one text file per document."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerloom.sinks.named_files import write_named_files


def write_csv(df: DataFrame, path: str, header: bool = True, skip_empty: bool = True, mode: str = "errorifexists") -> bool:
    """Write CSV with " as quote and \\ as escape; an empty frame is skipped. True if written."""
    if skip_empty and df.isEmpty():
        return False
    df.write.mode(mode).option("header", header).option("escape", "\\").csv(path)
    return True


def write_matrix(df: DataFrame, features: str, path: str, width: int, mode: str = "errorifexists") -> None:
    """Write an array column as CSV without header, one matrix row per line."""
    cells = [F.get(F.col(features), F.lit(i)).alias(f"_{i}") for i in range(width)]
    df.select(*cells).write.mode(mode).option("header", False).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Write Parquet and return the number of rows, counted during the write."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).parquet(path)
    return seen.get["rows"]


def write_text_files(df: DataFrame, key: str, text: str, path: str, mode: str = "append", flat: bool = False) -> None:
    """One file file_{key}.txt per document with exactly its text, in a folder per task or, with `flat`, in one.

    Nothing is left of a write that fails. A null text makes an empty file, a
    null key is an error. See `write_named_files`.
    """
    name = F.concat(F.lit("file_"), F.col(key).cast("string"), F.lit(".txt"))
    write_named_files(df, name, F.col(text), path, mode, flat)


def decoded_key(key: Column) -> Column:
    """Undo the URL encoding of an object key; one that is not encoded stays."""
    return F.coalesce(F.try_url_decode(key), key)


def decoded_path(path: Column) -> Column:
    """Undo the percent encoding of a URI path, in which a plus sign stands for itself."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def dataset_name(key: Column, when: dt.datetime | Column) -> Column:
    """{file stem}_{yyyyMMddHHmmss}: the stem is the file name up to its first dot."""
    stem = F.substring_index(F.substring_index(key, "/", -1), ".", 1)
    time = F.lit(f"{when:%Y%m%d%H%M%S}") if isinstance(when, dt.datetime) else F.date_format(when, "yyyyMMddHHmmss")
    return F.concat(stem, F.lit("_"), time)


def dataset_path(root: str, key: str, when: dt.datetime) -> str:
    """The output folder of one input file, new for every second; a second run in it finds the folder and stops."""
    stem = key.rstrip("/").rsplit("/", 1)[-1].split(".", 1)[0]
    return f"{root.rstrip('/')}/data/{stem}_{when:%Y%m%d%H%M%S}"
