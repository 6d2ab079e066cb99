"""Repeatable pseudo-random choices from MD5, the same on every engine and run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_hash(key: Column, *salts) -> Column:
    """MD5 in hex of the key and the salts, joined by colons."""
    parts = [key.cast("string")]
    for salt in salts:
        parts += [F.lit(":"), salt.cast("string") if isinstance(salt, Column) else F.lit(str(salt))]
    return F.md5(F.concat(*parts).cast("binary"))


def hash_below(hex_hash: Column, fraction: float) -> Column:
    """True for the given fraction of all hashes (32 bits of resolution)."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("the fraction must lie between 0 and 1")
    if fraction == 1.0:
        return F.lit(True)
    return F.substring(hex_hash, 1, 8) < F.lit(format(int(fraction * 16**8), "08x"))


def hash_pick(hex_hash: Column, offset: int, n: int) -> Column:
    """A number in 0..n-1 from 8 hex digits of the hash, starting at `offset`."""
    digits = F.substring(hex_hash, offset + 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(n)).cast("int")
