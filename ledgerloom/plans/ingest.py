"""Batch ingest: CSV to typed Parquet, and the re-typing of all-text rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sinks.files import dataset_path, write_parquet
from ledgerloom.sources.catalog import register_table
from ledgerloom.sources.files import infer_csv_schema, read_csv

SAMPLE_ROWS = 5


class EmptyInputError(ValueError):
    """Raised where an input without rows would be converted."""


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The frame itself; an error if it has no rows. Reads one row at most."""
    if df.isEmpty():
        raise EmptyInputError(f"no rows in {what}")
    return df


def first_rows(df: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    return df.limit(n)


def apply_mapping(df: DataFrame, names: Sequence[str], types: Sequence[T.DataType | str] | None = None) -> DataFrame:
    """Rename the columns by position and cast them; counts must match."""
    types = [f.dataType for f in df.schema] if types is None else types
    if not len(df.columns) == len(names) == len(types):
        raise ValueError(f"{len(df.columns)} columns, {len(names)} names, {len(types)} types")
    renamed = df.toDF(*names)
    return renamed.select(*[F.col(f"`{n}`").cast(t).alias(n) for n, t in zip(names, types)])


@dataclass(frozen=True)
class Conversion:
    """What a CSV conversion wrote."""

    path: str
    rows: int
    schema: T.StructType


def csv_to_parquet(
    spark: SparkSession,
    input_path: str,
    output_root: str,
    when: dt.datetime,
    schema: T.StructType | None = None,
    corrupt_column: bool = False,
    **dialect,
) -> Conversion:
    """Convert CSV files to one typed Parquet data set under {output_root}/data.

    One pass finds the types (none with a `schema`) and one writes; the rows are
    counted by the write. An input without rows is an error.
    """
    schema = schema or infer_csv_schema(spark, input_path, **dialect)
    typed = read_csv(spark, input_path, schema, corrupt_column, **dialect)
    path = dataset_path(output_root, input_path, when)
    rows = write_parquet(require_rows(typed, input_path), path)
    return Conversion(path, rows, schema)


def convert_and_register(
    spark: SparkSession, input_path: str, output_root: str, when: dt.datetime, database: str, prefix: str = "", **options
) -> str:
    """csv_to_parquet, then a table over the result; an error in either stops the job."""
    done = csv_to_parquet(spark, input_path, output_root, when, **options)
    return register_table(spark, done.path, database, prefix)


# Forms of text that count as numbers.
_WHOLE_NUMBER = r"^\s*[+-]?[0-9]+\s*$"
_POINT_NUMBER = r"^\s*[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _type_states(texts: Sequence[str]) -> list[Column]:
    """Per text column whether all non-empty values are whole numbers, and whether they are numbers; null if none is."""

    def whole(c):
        return c.rlike(_WHOLE_NUMBER) & c.try_cast("bigint").isNotNull()

    def number(c):
        return whole(c) | (c.rlike(_POINT_NUMBER) & c.try_cast("double").isNotNull())

    states = []
    for i, name in enumerate(texts):
        value = F.col(_quoted(name))
        states += [
            F.bool_and(F.when(value != "", test(value))).alias(f"{state}_{i}")
            for state, test in (("whole", whole), ("number", number))
        ]
    return states


def _quoted(name: str) -> str:
    return f"`{name}`"


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType == T.StringType()]


def _retyped(df: DataFrame, texts: Sequence[str], found: dict) -> DataFrame:
    """`df` with the text columns cast to what their states allow."""
    types = {}
    for i, name in enumerate(texts):
        if found[f"whole_{i}"]:
            types[name] = "bigint"
        elif found[f"number_{i}"]:
            types[name] = "double"
    columns = ((c, F.col(_quoted(c))) for c in df.columns)
    return df.select(*[value.try_cast(types[c]).alias(c) if c in types else value for c, value in columns])


def retype_strings(df: DataFrame) -> DataFrame:
    """Give text columns the narrowest of bigint, double and string that fits all values.

    A column is promoted only if each of its non-empty values is a number, then
    empty values become NULL. One aggregate over the data decides for all
    columns and returns a single row; `df` is read again where the result is
    used. `retype_once` reads it once.
    """
    texts = _text_columns(df)
    return _retyped(df, texts, df.agg(*_type_states(texts)).first().asDict()) if texts else df


def retype_once(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """As `retype_strings`, with one scan of `df`: its texts are written as Parquet, and the types observed meanwhile.

    Each task adds its rows' states to those of the others, so the types are
    known when the write ends. The result casts as it reads what was written.
    """
    texts = _text_columns(df)
    seen = Observation()
    observed = df.observe(seen, *_type_states(texts)) if texts else df
    observed.write.mode(mode).parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    return _retyped(written, texts, seen.get) if texts else written
