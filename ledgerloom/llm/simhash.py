"""Near-duplicates by SimHash, found in BK-trees.

Fingerprints with at most three differing bits agree in at least two of five
blocks of bits, so pairs of blocks deal the distinct fingerprints out to shards
such that every link lies inside a shard. Each shard is a BK-tree: a node's
children are keyed by their Hamming distance to it, and a search for radius r
at distance d follows only the edges from d - r to d + r.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.storage import saved

RADIUS = 3
SHINGLE = 3
SEED = 42
# Five blocks of the 64 bits: (first bit, number of bits).
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
# Fingerprints in one tree. A larger shard is split into parts of this size; the tree of each part
# is searched for the fingerprints of each part, one pair of parts to a group.
TREE = 1024
_SAMPLE = 1 << 16


def fingerprint(text: str | None) -> int:
    """The SimHash of a text: bit i is set if it is set in over half of the shingles' hashes.

    Words are runs of other than space and tab to carriage return, with A-Z in
    lower case; shingles are three words with single spaces, repeats included.
    Fewer words are one shingle; none, and a null text, give 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - [len(w) for w in words]).tolist()
    ends = ends.tolist()
    width = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    votes, n = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, _SAMPLE):
        upto = min(n, at + _SAMPLE)
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at:upto], ends[at + width - 1 :], strict=False)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], _PRINT_NAMES)


_PRINT_NAMES = ["doc_id", "tie", "fingerprint"]


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of the text) and fingerprint (bigint) of every row of `docs`."""
    narrow = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("tie"), "text")
    return narrow.mapInArrow(_fingerprints, "doc_id bigint, tie bigint, fingerprint bigint")


class BKTree:
    """The distinct integers `values`, built level by level for all nodes at once.

    Children of a node are sorted by their distance to it: `child_keys` and
    `children` between `first[node]` and `first[node + 1]`.
    """

    def __init__(self, values: np.ndarray):
        self.values = values = np.asarray(values, np.uint64)
        n = len(values)
        parent, key = np.full(n, -1), np.zeros(n, np.int64)
        at, rest = np.zeros(n, np.int64), np.arange(1, n)
        while len(rest):
            distance = np.bitwise_count(values[at[rest]] ^ values[rest]).astype(np.int64)
            edge = at[rest] * 65 + distance
            # The first value to come along an edge is the child there; the others go on to it.
            _, head, member = np.unique(edge, return_index=True, return_inverse=True)
            child = rest[head]
            parent[child], key[child] = at[child], distance[head]
            at[rest] = child[member]
            rest = np.delete(rest, head)
        nodes = np.arange(1, n)
        nodes = nodes[np.lexsort((key[1:], parent[1:]))]
        self.children = nodes
        self.edge = parent[nodes] * 65 + key[nodes]

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in queries, node) at most `radius` apart."""
        queries = np.asarray(queries, np.uint64)
        query, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        found_query, found_node = [], []
        while len(query):
            distance = np.bitwise_count(queries[query] ^ self.values[node]).astype(np.int64)
            near = distance <= radius
            found_query.append(query[near])
            found_node.append(node[near])
            low = np.searchsorted(self.edge, node * 65 + np.maximum(distance - radius, 0), "left")
            high = np.searchsorted(self.edge, node * 65 + np.minimum(distance + radius, 64), "right")
            sizes = high - low
            step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            node = self.children[np.repeat(low, sizes) + step]
            query = np.repeat(query, sizes)
        empty = [np.zeros(0, np.int64)]
        return np.concatenate(found_query or empty), np.concatenate(found_node or empty)


def _roots(n: int, a: np.ndarray, b: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Smallest place reachable from each of n places over the links, with the links so far in `roots`."""
    while True:
        low = np.minimum(roots[a], roots[b])
        before = roots.copy()
        np.minimum.at(roots, a, low)
        np.minimum.at(roots, b, low)
        np.minimum.at(roots, before, roots)
        roots = roots[roots]
        if (roots == before).all():
            return roots


def tree_links(values: np.ndarray, tree: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of the ascending distinct `values` the place of the smallest one linked to it.

    `tree` marks those that are in the tree; all of them are searched for, a
    block at a time, and links are merged as they come, so that no list of all
    pairs of a dense shard is ever held.
    """
    members = np.flatnonzero(tree)
    roots = np.arange(len(values))
    if not len(members):
        return roots
    found = BKTree(values[members])
    step = max(64, (1 << 21) // max(1, len(members)))
    for at in range(0, len(values), step):
        query, node = found.search(values[at : at + step], radius)
        roots = _roots(len(values), query + at, members[node], roots)
    return roots


def _shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each shard. The rows come sorted by shard; a shard may span batches."""
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def links(shard, value, in_tree):
        bounds = np.flatnonzero(np.diff(shard, prepend=shard[0] - 1))
        sizes = np.diff(np.append(bounds, len(shard)))
        left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for at, size in zip(bounds[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            values, where = np.unique(value[at : at + size], return_index=True)
            roots = tree_links(values, in_tree[at : at + size][where])
            linked = np.flatnonzero(roots != np.arange(len(values)))
            left.append(values[linked])
            right.append(values[roots[linked]])
        pair = [np.concatenate(x).view(np.int64) for x in (left, right)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in pair], ["left", "right"])

    for batch in batches:
        if not batch.num_rows:
            continue
        shard, value = (batch.column(i).to_numpy() for i in (0, 1))
        in_tree = batch.column(2).to_numpy(zero_copy_only=False)
        kept.append((shard, value.view(np.uint64), in_tree))
        if shard[0] != shard[-1]:  # all but the last shard are complete
            shard, value, in_tree = (np.concatenate(x) for x in zip(*kept, strict=True))
            cut = int(np.searchsorted(shard, shard[-1]))
            kept = [(shard[cut:], value[cut:], in_tree[cut:])]
            yield links(shard[:cut], value[:cut], in_tree[:cut])
    if kept:
        yield links(*(np.concatenate(x) for x in zip(*kept, strict=True)))


def _shards(fingerprints: DataFrame) -> DataFrame:
    """shard, fingerprint, in_tree: each fingerprint under every pair of its blocks.

    A shard of more than TREE fingerprints is dealt out as pairs of parts: the
    tree of one part and the searches of another, or of the same.
    """
    block = [F.shiftrightunsigned("fingerprint", at).bitwiseAND(F.lit((1 << size) - 1)) for at, size in BLOCKS]
    pairs = list(itertools.combinations(range(len(BLOCKS)), 2))
    keys = [F.xxhash64(F.lit(i), block[a], block[b]) for i, (a, b) in enumerate(pairs)]
    dealt = fingerprints.select("fingerprint", F.explode(F.array(*keys)).alias("key"))
    large = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    sized = dealt.join(large, "key").withColumn("parts", F.ceil(F.col("n") / TREE).cast("int"))
    part = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    split = sized.withColumn("part", part).withColumn("other", other)
    shard = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
    return split.select(shard.alias("shard"), "fingerprint", (F.col("part") <= F.col("other")).alias("in_tree"))


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, tie, fingerprint, root (a fingerprint) for every row."""
    marked = saved(with_fingerprints(docs), "fingerprints")
    distinct = saved(marked.select("fingerprint").distinct(), "distinct-fingerprints")
    ordered = _shards(distinct).repartition("shard").sortWithinPartitions("shard")
    links = ordered.mapInArrow(_shard_links, "left bigint, right bigint")
    roots = components(links, "left", "right").withColumnRenamed("node", "fingerprint")
    linked = marked.join(roots, "fingerprint", "left")
    return linked.withColumn("root", F.coalesce("root", "fingerprint"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (bigint), component_id for every row of `docs` (doc_id, text).

    Documents whose fingerprints differ in at most RADIUS bits are linked;
    component_id is the smallest doc_id that can be reached. Equal fingerprints
    meet once in the search, whatever the number of copies. A null doc_id takes
    part, but names a component only if no other id is reached; null and empty
    texts have fingerprint 0 and are linked like others. Other columns are not
    read; no rows give no rows.
    """
    found = _classes(docs)
    ids = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(ids, "root").select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each component, that with the smallest doc_id (null last).

    Of several rows with that doc_id the one with the smallest hash of its text
    stays, and of rows alike in that too any one.
    """
    found = _classes(docs)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "tie")).alias("first")
    chosen = found.groupBy("root").agg(least).select("first.doc_id", "first.tie")
    chosen = chosen.select(F.col("doc_id").alias("chosen_id"), F.col("tie").alias("chosen_tie"))
    row = F.struct(*(docs[f"`{name}`"] for name in docs.columns)).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("tie"))
    same = F.col("id").eqNullSafe(F.col("chosen_id")) & (F.col("tie") == F.col("chosen_tie"))
    kept = rows.join(saved(chosen, "chosen"), same, "left_semi")
    place = F.row_number().over(Window.partitionBy("id", "tie").orderBy("tie"))
    once = kept.withColumn("place", place).where(F.col("place") == 1)
    return once.select(*(F.col(f"row.`{name}`") for name in docs.columns))


def simhash_components(spark, folder) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    text = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return near_duplicates(docs).select("doc_id", text, "component_id")
