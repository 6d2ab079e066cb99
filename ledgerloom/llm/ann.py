"""Approximate nearest neighbours by learned partitions.

A router learnt on a bounded sample deals all vectors out to parts; a query is
sent to its most probable parts and compared exactly with the vectors there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.partitions import Router, learn_router, probes_for
from ledgerloom.llm.storage import saved

# Distinct vectors the router is learnt from and the number of probes measured on: those with the smallest hashes.
SAMPLE = 8192
CALIBRATION = 512
RECALL = 0.95
PARTS = 128
# Vectors and queries that meet in one group.
BLOCK = 8192
QUERY_BLOCK = 2048


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """Per distinct vector: print (a 64-bit hash), vector, ids (its `keep` smallest vec_ids).

    Copies of a vector are equally near to anything, and ties go to the smaller
    id, so no more ids than that can be among the nearest. The rank limit cuts
    the copies before the shuffle.
    """
    place = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = rows.withColumn("place", place).where(F.col("place") <= keep)
    ids = F.array_sort(F.collect_set("vec_id")).alias("ids")
    return few.groupBy("vector").agg(ids).select(F.xxhash64("vector").alias("print"), "vector", "ids")


def learn(vectors: DataFrame, n: int, k: int, recall: float, sample: int = SAMPLE) -> tuple[Router, int]:
    """The router and the number of parts to probe, from the `sample` vectors with the smallest hashes."""
    table = vectors.orderBy("print").limit(sample).select("vector").toArrow()
    unit = _unit(_matrix(table.column("vector")))
    parts = max(1, min(PARTS, round(math.sqrt(n) / 4), len(unit) // 8))
    # The router does not see the vectors for which the probes are counted.
    held = min(CALIBRATION, len(unit) // 5)
    router = learn_router(unit[: len(unit) - held], parts)
    asked = np.arange(len(unit) - held, len(unit)) if held else np.arange(len(unit))
    return router, probes_for(router, unit, asked, k, recall)


def _assigned(router: Router):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = router.logits(_unit(_matrix(batch.column(1)))).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], ["print", "vector", "ids", "part"])

    return assign


def _routed(router: Router, probes: int):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ranked = router.ranked(_unit(_matrix(batch.column(1))))[:, :probes].astype(np.int32)
                lists = pa.array(ranked.tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["print", "vector", "parts"])

    return route


def _nearest(keep: int):
    """Per query the `keep` nearest ids of a group, equal scores by id."""
    names = pa.schema([("print", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def find(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return names.empty_table()
        asked, there = _matrix(queries.column("vector")), _matrix(candidates.column("vector"))
        prints = queries.column("print").to_numpy()
        ids = candidates.column("ids").to_pylist()
        norms = np.sqrt((there * there).sum(axis=1))
        unit = _unit(there)
        out: list[tuple[int, int, float]] = []
        for at in range(0, len(asked), 256):
            block = asked[at : at + 256]
            rough = _unit(block) @ unit.T
            last = np.partition(rough, -min(keep, len(there)), axis=1)[:, -min(keep, len(there))]
            # The product rounds by its position; all that may be among the first are scored anew.
            query, place = np.nonzero(rough >= last[:, None] - 1e-9)
            dots = (block[query] * there[place]).sum(axis=1)
            score = dots / (np.sqrt((block * block).sum(axis=1))[query] * norms[place])
            for q in range(len(block)):
                mine = slice(*np.searchsorted(query, [q, q + 1]))
                named = [(-s, i) for s, p in zip(score[mine].tolist(), place[mine].tolist(), strict=True) for i in ids[p]]
                out += [(int(prints[at + q]), i, -s) for s, i in sorted(set(named))[:keep]]
        return pa.Table.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=names)

    return find


def search(
    embeddings: DataFrame, every: int = 50, k: int = 5, recall: float = RECALL, sample: int = SAMPLE
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found to each row whose vec_id `every` divides.

    `embeddings` has vec_id and embedding. The score is the cosine in double
    precision of the vectors as given; ties go to the smaller vec_id. A row is
    no candidate for its own vec_id. Null ids, and vectors that are null, zero,
    of another length than most of the others (of the longer, if as many have
    it), or hold null or non-finite components take no part. Repeated rows count once; a query with several vectors gets
    the nearest to any of them. No rows give no rows; other columns are not read.

    The probes are as many as find `recall` of the neighbours inside the sample.
    Groups of BLOCK vectors and QUERY_BLOCK queries split a part that holds many,
    so the largest part is no single task.
    """
    keep = k + 1
    rows = embeddings.select(F.col("vec_id").cast("bigint"), F.col("embedding").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    rows = rows.where(F.size("vector") == (usual["length"] if usual else 0))
    asked = F.col("vec_id") % every == 0
    vectors = saved(distinct_vectors(rows, keep), "vectors")
    n = vectors.count()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not n:
        return embeddings.sparkSession.createDataFrame([], schema)
    router, probes = learn(vectors, n, k, recall, sample)

    kind = rows.schema["vector"].dataType.simpleString()
    index = saved(
        vectors.mapInArrow(_assigned(router), f"print bigint, vector {kind}, ids array<bigint>, part int"), "ann-index"
    )
    named = rows.where(asked).select("vec_id", F.xxhash64("vector").alias("print"), "vector")
    named = saved(named.distinct(), "ann-queries")
    queries = named.select("print", "vector").distinct()
    routed = queries.mapInArrow(_routed(router, probes), f"print bigint, vector {kind}, parts array<int>")
    routed = saved(routed.withColumn("part", F.explode("parts")).drop("parts"), "ann-routed")

    # One row per part, at most PARTS, tells into how many blocks each side is split.
    sizes = index.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    loads = routed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("query_blocks"))
    split = F.broadcast(sizes.join(loads, "part"))
    block = F.pmod("print", F.col("blocks")).cast("int")
    query_block = F.pmod("print", F.col("query_blocks")).cast("int")
    there = index.join(split, "part").select(
        "part",
        block.alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"),
        "vector",
        "ids",
    )
    here = routed.join(split, "part").select(
        "part",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        query_block.alias("query_block"),
        "print",
        "vector",
    )
    keys = ("part", "block", "query_block")
    pairs = here.groupBy(*keys).cogroup(there.groupBy(*keys))
    found = pairs.applyInArrow(_nearest(keep), "print bigint, vec_id bigint, score double")

    order = [F.col("score").desc(), F.col("vec_id")]
    best = F.row_number().over(Window.partitionBy("print").orderBy(*order))
    found = found.withColumn("place", best).where(F.col("place") <= keep).drop("place")
    answers = named.select(F.col("vec_id").alias("query_id"), "print").join(found, "print")
    answers = answers.where(F.col("query_id") != F.col("vec_id"))
    answers = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_vectors(spark, folder) -> DataFrame:
    return search(spark.read.parquet(f"{folder}/embeddings.parquet"))
