"""Repeatable samples and splits by key hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.hashing import hash_below, keyed_hash

# Hex digits by which a search goes on: at most 65,536 counts per pass reach the driver.
_STEP = 4


def _last_prefix(df: DataFrame, digits: Column, length: int, n: int) -> tuple[str, int]:
    """The prefix of `digits` up to which there are n rows, and how many of its own rows belong to them.

    Each pass counts the rows by the next digits behind the prefix found so far.
    It ends where the prefix and those before it hold exactly n rows, or with
    all digits.
    """
    prefix, rest = "", n
    while True:
        size = len(prefix) + _STEP
        inside = df.where(digits.startswith(prefix)) if prefix else df
        counts = inside.groupBy(F.substring(digits, 1, size).alias("prefix")).agg(F.count(F.lit(1)).alias("rows"))
        for row in sorted(counts.collect()):
            prefix = row["prefix"]
            if row["rows"] >= rest:
                break
            rest -= row["rows"]
        if row["rows"] <= rest or size >= length:
            return prefix, min(rest, row["rows"])


def sample_rows(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """Exactly n rows (all if there are fewer), chosen by the hash of their key.

    Sorting all rows to keep n would send n whole rows of every partition to
    one task. Here passes over the key alone find the hash up to which there
    are n rows, and those rows are filtered in place. A NULL key is a key like
    any other. Rows of one key are chosen by a hash of the whole row, so the key
    should be nearly unique; rows alike in that too are interchangeable.
    """
    if n <= 0:
        return df.where(F.lit(False))
    digits = keyed_hash(F.coalesce(F.col(key).cast("string"), F.lit("")), seed)
    total = df.count()
    if total <= n:
        return df
    prefix, rest = _last_prefix(df.select(digits.alias("digits")), F.col("digits"), 32, n)
    if len(prefix) < 32:
        return df.where(F.substring(digits, 1, len(prefix)) <= prefix)
    before, same = df.where(digits < prefix), df.where(digits == prefix)
    whole = F.md5(F.to_json(F.struct(*df.columns)))
    last, rest = _last_prefix(same.select(whole.alias("digits")), F.col("digits"), 32, rest)
    chosen = same.where(F.substring(whole, 1, len(last)) < last)
    return before.unionAll(chosen).unionAll(same.where(F.substring(whole, 1, len(last)) == last).limit(rest))


def train_test_split(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Add a column `split` (train or test) from the hash of the key; no shuffle."""
    is_train = hash_below(keyed_hash(F.col(key), seed), 1.0 - test_fraction)
    return df.withColumn("split", F.when(is_train, "train").otherwise("test"))


def split_counts(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
