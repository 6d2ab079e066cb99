"""Column expressions on tag maps.

A NULL map counts as neither tagged nor untagged: `tag_count` is NULL for it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_value(tags: Column, key: str) -> Column:
    """The value under a key, NULL where the key is missing."""
    return F.try_element_at(tags, F.lit(key))


def has_tag(tags: Column, key: str) -> Column:
    """True where the key has a non-empty value, else false."""
    return F.coalesce(tag_value(tags, key) != "", F.lit(False))


def tag_count(tags: Column) -> Column:
    """Number of keys; NULL for a NULL map in every ANSI setting."""
    return F.when(tags.isNotNull(), F.size(F.map_keys(tags)))


def is_tagged(tags: Column) -> Column:
    """True where the map has a key, else false (also for a NULL map)."""
    return F.coalesce(tag_count(tags) > 0, F.lit(False))


def tags_text(tags: Column) -> Column:
    """A map as sorted key=value text: equal maps give equal text."""
    entries = F.array_sort(F.map_entries(tags))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ","
    )
