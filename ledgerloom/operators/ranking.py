"""Sorting and top-k with a total order, so that results repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def descending(*columns: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in columns]


def ascending(*columns: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def top_k(df: DataFrame, k: int | None, by: str, ties: Sequence[str]) -> DataFrame:
    """The k rows with the largest `by`; equal ones in the order of `ties`.

    With a k Spark keeps k rows per partition and merges those. Without one
    (None) this is a distributed sort.
    """
    ordered = df.orderBy(*descending(by), *ascending(*ties))
    return ordered if k is None else ordered.limit(k)


SALTS = 64


def _first_ranks(df: DataFrame, k: int, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= k).drop("_rank")


def top_k_per_group(
    df: DataFrame, k: int, group: Sequence[str], order: Sequence[Column], salt_by: Sequence[str], salts: int = SALTS
) -> DataFrame:
    """The first k rows of each group in a total order.

    Each group is ranked in `salts` parts first, dealt out by a hash of the
    `salt_by` columns, and then among the first k rows of its parts. So no task
    sorts more than 1/salts of a hot group or k rows of each part; where k is
    small, Spark also cuts the parts to k rows per task before the shuffle.
    """
    parts = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)))
    first = _first_ranks(parts, k, [*group, "_salt"], order).drop("_salt")
    return _first_ranks(first, k, group, order)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one with the largest `order` columns.

    A max_by aggregate, combined map-side, so a hot key moves one row per task.
    """
    values = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*values), F.struct(*order)).alias("_newest")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col("_newest")[c].alias(c) for c in values]).select(*df.columns)
