"""Best-fit packing of documents into sequences of several permitted lengths.

Pieces go in descending length into the open bin they fill best. If none has
room, a bin opens in the size that costs least per word it can expect to hold.
In the end every bin shrinks to the smallest permitted length for its contents.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.storage import saved
from ledgerloom.llm.words import n_words

SIZES = (256, 512, 1024, 2048, 4096)
# Pieces packed together. Bins are filled from one group only; the share that stays
# empty falls with the size of the group and is below a percent from a few hundred on.
GROUP = 4096


def attention_cost(size: int) -> float:
    """Work for one sequence: linear layers, and attention that doubles it at 8192."""
    return size + size * size / 8192


def _opened(length: int, rest: int, sizes: Sequence[int], cost: Callable[[int], float]) -> int:
    """The size with the least cost per word that can be expected in it."""
    return min((s for s in sizes if s >= length), key=lambda s: (cost(s) / min(s, length + rest), s))


def _fill(lengths: Sequence[int], sizes: Sequence[int], cost) -> tuple[list[int], list[int], list[int]]:
    """Bin and place of each length (descending), and the bins' shrunk sizes."""
    room: dict[int, list[int]] = {}  # bins by the words they still take
    present = 0  # bit r: some bin has room r
    used: list[int] = []
    bins, places, rest = [], [], sum(lengths)
    for length in lengths:
        rest -= length
        fits = present >> length
        if fits:
            left = length + (fits & -fits).bit_length() - 1
            own = room[left].pop()
            if not room[left]:
                present ^= 1 << left
        else:
            left = _opened(length, rest, sizes, cost)
            own = len(used)
            used.append(0)
        bins.append(own)
        places.append(used[own])
        used[own] += length
        left -= length
        if left:
            stack = room.setdefault(left, [])
            if not stack:
                present |= 1 << left
            stack.append(own)
    return bins, places, [min(s for s in sizes if s >= u) for u in used]


def best_fit(lengths: Sequence[int], sizes: Sequence[int] = SIZES, cost: Callable[[int], float] = attention_cost):
    """Pack descending `lengths`, none above the largest size: (bin, place, bin sizes).

    The permitted sizes are weighed together: one packing lets bins open in
    all of them, others only from the second, third, ... size on, in the
    expectation that they shrink; the cheapest in the end wins.
    """
    sizes = sorted(sizes)
    tries = [
        _fill(lengths, sizes, lambda s, least=least: cost(s) if s >= least else float("inf")) for least in sizes
    ]
    return min(tries, key=lambda found: sum(map(cost, found[2])))


_OUT = "doc_id bigint, piece bigint, start bigint, n_words bigint, bin_id bigint, bin_size bigint, place bigint"


def _packed(sizes: Sequence[int], cost: Callable[[int], float]):
    names = ["doc_id", "piece", "start", "n_words", "bin_id", "bin_size", "place"]

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = table.column("n_words").to_pylist()
        bins, places, shrunk = best_fit(lengths, sizes, cost)
        first = table.column("group")[0].as_py() << 32
        own = np.array(bins, np.int64)
        columns = [table.column(n).combine_chunks() for n in names[:4]]
        columns += [pa.array(x) for x in (own + first, np.array(shrunk, np.int64)[own], np.array(places, np.int64))]
        return pa.Table.from_arrays(columns, names)

    return pack


def pieces(docs: DataFrame, size: Column, longest: int) -> DataFrame:
    """doc_id, piece, start, n_words: each document in pieces of at most `longest` words."""
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), size.cast("bigint").alias("size"))
    count = F.greatest(F.lit(1), F.ceil(F.col("size") / longest)).cast("bigint")
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)))
    start = F.col("piece") * longest
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.lit(longest), F.col("size") - start).alias("n_words"))


def pack(
    docs: DataFrame,
    size: Column | None = None,
    sizes: Sequence[int] = SIZES,
    cost: Callable[[int], float] = attention_cost,
    group: int = GROUP,
) -> DataFrame:
    """doc_id, piece, start, n_words, bin_id, bin_size, place: where the words of each document go.

    `size` is the length of a document, its words by default (a null one is 0).
    A document longer than the largest size is cut into pieces of that size and
    a rest, none left out; `start` is the first word of a piece. `place` is the
    first word of the piece in its bin, and bin_size, one of `sizes`, is at
    least the sum of n_words in the bin. A document without words is one piece
    of no words, in no bin. Rows of one doc_id are packed one by one.

    Pieces are dealt out by hash to groups of about `group`, each packed by
    one task from lengths alone; texts are not moved. A full group can only
    grow by rows alike in doc_id, piece and length.
    """
    longest = max(sizes)
    size = n_words(F.col("text")) if size is None else F.coalesce(size, F.lit(0))
    cut = saved(pieces(docs, size, longest), "pieces")
    some = cut.where("n_words > 0")
    groups = max(1, -(-some.count() // group))
    keyed = some.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "n_words"), F.lit(groups)))
    packed = keyed.groupBy("group").applyInArrow(_packed(tuple(sizes), cost), _OUT)
    none = F.lit(None).cast("bigint")
    empty = cut.where("n_words = 0").select(
        "doc_id", "piece", "start", "n_words", none.alias("bin_id"), none.alias("bin_size"), none.alias("place")
    )
    return packed.unionByName(empty)


def packing(spark, folder) -> DataFrame:
    return pack(spark.read.parquet(f"{folder}/documents.parquet"))
