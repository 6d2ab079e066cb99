"""Connected components as joins and aggregates (union-find without a single task)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.storage import saved

_DONE = 60


def _min_neighbours(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _min_neighbours(both).select("u", F.least("u", "m").alias("m"))
    joined = both.where(F.col("v") > F.col("u")).join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. `edges` has u > v."""
    least = _min_neighbours(edges)
    joined = edges.join(least, "u")
    moved = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """node, root for every node of the edges; root is the smallest node it is linked to.

    Large-star and small-star steps alternate until every node has one link, to
    its root, which takes a number of rounds that grows with the logarithm of
    the longest path. Each round aggregates the smallest neighbour of a node
    map-side and joins it back, so a node with very many links is never in one
    task. Every round is saved; null ends and loops are ignored, no edges give
    no rows.
    """
    pairs = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    pairs = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v")))
    current = saved(pairs.distinct(), "links")
    for _ in range(_DONE):
        # A forest of stars: one link to each linked node, and no root has a link itself.
        loose = current.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
        chained = current.join(current.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        if loose.unionAll(chained).isEmpty():
            break
        current = saved(_small_star(_large_star(current)), "links")
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
