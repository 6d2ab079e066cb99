"""Gradient boosted trees by second-order histograms, one tree per class and round.

Rows are cut into bins of each feature once. For each level of the trees of a
round, tasks add the first and second derivatives of the loss up by class,
node, feature and bin, an aggregate sums these, and windows over the bins find
the split with the greatest gain; one row per node comes back to the driver.
Sums are of whole numbers, so trees do not depend on how rows are partitioned.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import ship_package

# Derivatives are summed in units of 2^-30: of 2^33 rows the sums fit 64 bits.
_UNIT = float(1 << 30)
_LEAST_HESSIAN = 1e-16
MAX_BINS = 256
# Rows that are worth a task.
_LEAST_ROWS = 4096
# Cells of histograms that a task sums up.
_CELLS = 200_000
_ACCURACY = 10_000


@dataclasses.dataclass(frozen=True)
class BoostingParams:
    """What training goes by. The gain of a split is GL²/(HL+l) + GR²/(HR+l) - G²/(H+l) with l = `reg_lambda`;
    it must exceed `gamma`, and both sides need a sum of second derivatives of `min_child_weight`."""

    eta: float = 0.3
    max_depth: int = 6
    rounds: int = 10
    gamma: float = 0.0
    min_child_weight: float = 1.0
    reg_lambda: float = 1.0
    subsample: float = 1.0
    bins: int = MAX_BINS
    seed: int = 42

    def __post_init__(self):
        if not 2 <= self.bins <= MAX_BINS or self.max_depth < 0 or not 0 < self.subsample <= 1:
            raise ValueError("2 to 256 bins, a depth of 0 or more, a subsample above 0 and up to 1")


@dataclasses.dataclass(frozen=True)
class Node:
    """A split (rows whose feature is below the threshold or missing go left) or, without a feature, a leaf."""

    value: float
    feature: int = -1
    threshold: float = 0.0
    bin: int = 0
    left: int = -1
    right: int = -1
    gain: float = 0.0


Tree = tuple[Node, ...]


class _Arrays:
    """A tree as arrays, to send many rows down at once by their bins."""

    def __init__(self, tree: Sequence[Node]):
        self.feature = np.array([max(n.feature, 0) for n in tree])
        self.bin = np.array([n.bin for n in tree])
        self.left = np.array([n.left if n.feature >= 0 else i for i, n in enumerate(tree)])
        self.right = np.array([n.right if n.feature >= 0 else i for i, n in enumerate(tree)])
        self.value = np.array([n.value for n in tree])
        levels = [0] * len(tree)
        for i, n in enumerate(tree):  # children come after their parent
            if n.feature >= 0:
                levels[n.left] = levels[n.right] = levels[i] + 1
        self.depth = max(levels)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(self.depth):
            left = bins[rows, self.feature[at]] <= self.bin[at]
            at = np.where(left, self.left[at], self.right[at])
        return at


def class_probabilities(margins: np.ndarray) -> np.ndarray:
    """Of margins (rows, classes) by softmax, or of one column by the logistic function."""
    if margins.shape[1] == 1:
        return 1 / (1 + np.exp(-margins))
    shifted = np.exp(margins - margins.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


def derivatives(margins: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log loss by each margin.

    Of several classes the second is twice p(1 - p), the bound that makes a step in all margins at once safe.
    """
    p = class_probabilities(margins)
    several = margins.shape[1] > 1
    hit = labels[:, None] == (np.arange(margins.shape[1]) if several else 1)
    return p - hit, np.maximum(p * (1 - p) * (2 if several else 1), _LEAST_HESSIAN)


def _sampled(keys: np.ndarray, round_: int, params: BoostingParams) -> np.ndarray:
    """Which rows a round learns from, by a hash of each row's key and the round."""
    if params.subsample >= 1:
        return np.ones(len(keys), bool)
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((params.seed * 1_000_003 + round_ + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)) < np.uint64(int(params.subsample * (1 << 53)))


# Bins


def bin_edges(data: DataFrame, width: int, bins: int) -> list[list[float]]:
    """Per feature up to bins - 1 values, ascending; a row is in the bin of how many of them it reaches.

    All distinct values where there are so few, else the least and quantiles of
    a mergeable sketch. The least value is left out where no value is missing,
    as nothing lies below it.
    """
    shares = [i / (bins - 1) for i in range(1, bins - 1)] or [0.5]
    cells = [F.get("features", F.lit(j)) for j in range(width)]
    present = [F.when(~F.isnan(c), c) for c in cells]
    found = data.agg(
        *(F.percentile_approx(c, shares, _ACCURACY).alias(f"q{j}") for j, c in enumerate(present)),
        *(F.min(c).alias(f"least{j}") for j, c in enumerate(present)),
        *(F.approx_count_distinct(c).alias(f"n{j}") for j, c in enumerate(present)),
        *(F.count_if(c.isNull()).alias(f"missing{j}") for j, c in enumerate(present)),
    ).first()
    few = [j for j in range(width) if found[f"n{j}"] <= 2 * bins]
    # At most some hundreds of values each.
    exact = data.agg(*(F.sort_array(F.collect_set(present[j])).alias(f"v{j}") for j in few)).first() if few else {}
    edges = []
    for j in range(width):
        values = list(exact[f"v{j}"]) if j in few else None
        if values is None or len(values) >= bins:
            values = [found[f"least{j}"], *sorted(set(found[f"q{j}"]) - {found[f"least{j}"]})]
        edges.append([float(v) for v in values[0 if found[f"missing{j}"] else 1 :]])
    return edges


def _binned(edges: list[list[float]]):
    def bin_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_pylist()
            values = np.array([[np.nan if v is None else v for v in row] for row in rows], float).reshape(len(rows), len(edges))
            bins = np.stack([np.searchsorted(e, values[:, j], "right") for j, e in enumerate(edges)], 1) if edges else values
            bins = np.where(np.isnan(values), 0, bins).astype(np.uint8)
            kept = pa.array([row.tobytes() for row in bins], pa.binary())
            yield pa.RecordBatch.from_arrays([kept, batch.column(1), batch.column(2)], ["bins", "label", "key"])

    return bin_rows


def _numbers(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, width)
    return bins, batch.column(1).to_numpy(), batch.column(2).to_numpy()


# One level of the trees of a round

_HISTOGRAM = "tree int, node int, feature int, bin int, g bigint, h bigint"


def _histograms(forest: list[list[Tree]], growing: list[list[Node]], active: list[list[int]], width: int, params: BoostingParams):
    """Sums of derivatives over the rows of a task by tree, node, feature and bin, of the active nodes."""

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = [[_Arrays(t) for t in trees] for trees in forest]
        now = [_Arrays(t) for t in growing]
        places = [dict(zip(nodes, range(len(nodes)))) for nodes in active]
        sums = [np.zeros((2, len(nodes), width, MAX_BINS), np.int64) for nodes in active]
        seen = [np.zeros((len(nodes), width, MAX_BINS), bool) for nodes in active]
        for batch in batches:
            bins, labels, keys = _numbers(batch, width)
            kept = _sampled(keys, len(forest), params)
            bins, labels = bins[kept], labels[kept]
            margins = np.zeros((len(bins), len(growing)))
            for trees in done:
                for k, tree in enumerate(trees):
                    margins[:, k] += tree.value[tree.nodes(bins)]
            for k, (g, h) in enumerate(zip(*(np.rint(d * _UNIT).T for d in derivatives(margins, labels)))):
                if not active[k]:
                    continue
                place = np.full(len(growing[k]), -1)
                place[list(places[k])] = list(places[k].values())
                slot = place[now[k].nodes(bins)]
                inside = slot >= 0
                for j in range(width):
                    index = slot[inside] * MAX_BINS + bins[inside, j]
                    size = len(active[k]) * MAX_BINS
                    for i, d in enumerate((g, h)):
                        sums[k][i, :, j] += np.bincount(index, d[inside], size).astype(np.int64).reshape(-1, MAX_BINS)
                    seen[k][:, j] |= np.bincount(index, minlength=size).reshape(-1, MAX_BINS) > 0
        for k, nodes in enumerate(active):
            slot, j, b = np.nonzero(seen[k])
            if len(slot):
                columns = [np.full(len(slot), k), np.array(nodes)[slot], j, b]
                arrays = [pa.array(c.astype(np.int32)) for c in columns] + [pa.array(sums[k][i, slot, j, b]) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(arrays, ["tree", "node", "feature", "bin", "g", "h"])

    return add_up


def best_splits(histograms: DataFrame, params: BoostingParams, partitions: int = 1) -> DataFrame:
    """tree, node, g, h of each node and its best split: gain, feature, bin, gl, hl (of its left side); null where none is allowed.

    `histograms` has tree, node, feature, bin, g, h, added up or not. Of equal
    gains the smallest feature and bin count. A node is in one task, with a cell
    per feature and bin, however many rows there are.
    """
    # The one shuffle: by node, which serves the sums, the windows and the choice.
    cells = histograms.repartition(partitions, "tree", "node").groupBy("tree", "node", "feature", "bin")
    whole = "PARTITION BY tree, node, feature"
    upto = f"{whole} ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    sums = cells.agg(F.sum("g").alias("g"), F.sum("h").alias("h")).selectExpr(
        "tree", "node", "feature", "bin", *(f"sum({c}) OVER ({w}) AS {c}{n}" for c in "gh" for w, n in ((upto, "l"), (whole, "")))
    )

    def score(g: str, h: str) -> str:
        return f"pow(({g}) / {_UNIT!r}D, 2) / (({h}) / {_UNIT!r}D + {float(params.reg_lambda)!r}D)"

    least, gamma = (f"{float(x)!r}D" for x in (params.min_child_weight, params.gamma))
    # A split after the last bin has nothing on its right.
    allowed = f"hl < h AND hl / {_UNIT!r}D >= {least} AND (h - hl) / {_UNIT!r}D >= {least} AND gain > {gamma}"
    ranked = sums.selectExpr("*", f"{score('gl', 'hl')} + {score('g - gl', 'h - hl')} - {score('g', 'h')} AS gain")
    split = "struct(gain, -feature AS f, -bin AS b, gl, hl)"
    best = ranked.selectExpr("tree", "node", "g", "h", f"CASE WHEN {allowed} THEN {split} END AS split")
    best = best.groupBy("tree", "node").agg(F.max("split").alias("best"), F.max("g").alias("g"), F.max("h").alias("h"))
    return best.selectExpr("tree", "node", "g", "h", "best.gain", "-best.f AS feature", "-best.b AS bin", "best.gl", "best.hl")


def _leaf_value(g: int, h: int, params: BoostingParams) -> float:
    return -params.eta * (g / _UNIT) / (h / _UNIT + params.reg_lambda)


def _round(rows: DataFrame, forest: list[list[Tree]], trees: int, edges: list[list[float]], params: BoostingParams) -> list[Tree]:
    """The trees of the next round, grown level by level."""
    growing: list[list[Node]] = [[Node(0.0)] for _ in range(trees)]
    active = [[0] for _ in range(trees)]
    for depth in range(max(1, params.max_depth)):
        sums = rows.mapInArrow(_histograms(forest, growing, active, len(edges), params), _HISTOGRAM)
        partitions = -(-sum(map(len, active)) * sum(len(e) + 1 for e in edges) // _CELLS)
        active = [[] for _ in range(trees)]
        for row in best_splits(sums, params, partitions).collect():  # a row per node
            tree, at = growing[row["tree"]], row["node"]
            value = _leaf_value(row["g"], row["h"], params)
            tree[at] = Node(value)
            if params.max_depth and row["gain"] is not None:
                left, threshold = len(tree), edges[row["feature"]][row["bin"]]
                tree[at] = Node(value, row["feature"], threshold, row["bin"], left, left + 1, row["gain"])
                sides = (row["gl"], row["hl"]), (row["g"] - row["gl"], row["h"] - row["hl"])
                tree += [Node(_leaf_value(*side, params)) for side in sides]
                active[row["tree"]] += [left, left + 1]
        if not any(active):
            break
    return [tuple(t) for t in growing]


def train_forest(
    data: DataFrame, classes: int, params: BoostingParams, partition_bytes: int = 64 << 20
) -> list[list[Tree]]:
    """The trees of each round, one per class, or one where there are two classes.

    `data` has features (array<double>, all of one size) and label (0..classes-1,
    others and null are left out). Missing values, null or NaN, go left. The rows
    are binned once, to a byte a feature, and kept in memory; each level of a
    round is one pass over them, in which their margins follow from the trees so
    far. No rows give single leaves of value 0.
    """
    ship_package(data.sparkSession)
    known = data.where(F.col("label").isin(list(range(classes)))).select("features", F.col("label").cast("int").alias("label"))
    size = known.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("width")).first()
    trees = 1 if classes == 2 else classes
    if not size["n"]:
        return [[(Node(0.0),)] * trees] * params.rounds
    edges = bin_edges(known, size["width"], params.bins)
    keyed = known.select("features", "label", F.xxhash64("features", "label").alias("key"))
    parallel = min(data.sparkSession.sparkContext.defaultParallelism, -(-size["n"] // _LEAST_ROWS))
    spread = keyed.repartition(max(parallel, -(-size["n"] * (size["width"] + 12) // partition_bytes)))
    rows = spread.mapInArrow(_binned(edges), "bins binary, label int, key bigint").persist()
    try:
        forest: list[list[Tree]] = []
        for _ in range(params.rounds):
            forest.append(_round(rows, forest, trees, edges, params))
        return forest
    finally:
        rows.unpersist()
