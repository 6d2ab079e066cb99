import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import boosting
from ledgerloom.plans.boosting import BoostingParams, Node, best_splits, train_forest
from ledgerloom.plans.models import BoostedTrees

UNIT = 1 << 30


def _margins(forest, rows, trees):
    """Margins of rows by walking down their values."""
    found = np.zeros((len(rows), trees))
    for round_ in forest:
        for k, tree in enumerate(round_):
            for i, row in enumerate(rows):
                at = tree[0]
                while at.feature >= 0:
                    value = row[at.feature]
                    missing = value is None or math.isnan(value)
                    at = tree[at.left if missing or value < at.threshold else at.right]
                found[i, k] += at.value
    return found


def _derivatives(margins, labels):
    """By the formulas, for each class and row."""
    found = []
    for k in range(margins.shape[1]):
        column = []
        for row, label in zip(margins, labels):
            if len(row) == 1:
                p, y, factor = 1 / (1 + math.exp(-row[0])), label == 1, 1
            else:
                p, y, factor = math.exp(row[k]) / sum(map(math.exp, row)), label == k, 2
            column.append((p - y, max(factor * p * (1 - p), 1e-16)))
        found.append(column)
    return found


def _grow(rows, pairs, inside, depth, params):
    """The tree by trying every threshold between values: (gain, feature, threshold, left, right) or a leaf's value."""
    g, h = (sum(pairs[i][j] for i in inside) for j in (0, 1))
    value = -params.eta * g / (h + params.reg_lambda)

    def score(some):
        return sum(pairs[i][0] for i in some) ** 2 / (sum(pairs[i][1] for i in some) + params.reg_lambda)

    best = None
    for f in range(len(rows[0])) if depth < params.max_depth else ():
        key = [-math.inf if rows[i][f] is None or math.isnan(rows[i][f]) else rows[i][f] for i in range(len(rows))]
        for t in sorted({key[i] for i in inside} - {-math.inf}):
            left, right = [i for i in inside if key[i] < t], [i for i in inside if key[i] >= t]
            weights = [sum(pairs[i][1] for i in side) for side in (left, right)]
            if not left or not right or min(weights) < params.min_child_weight:
                continue
            gain = score(left) + score(right) - score(inside)
            if gain > params.gamma and (best is None or gain > best[0] + 1e-7):
                best = gain, f, left, right
    if best is None:
        return value
    gain, f, left, right = best
    return gain, f, _grow(rows, pairs, left, depth + 1, params), _grow(rows, pairs, right, depth + 1, params)


def _same(tree, expected, at=0):
    node = tree[at]
    if not isinstance(expected, tuple):
        assert node.feature == -1 and node.value == pytest.approx(expected, abs=1e-6)
        return
    gain, feature, left, right = expected
    assert node.feature == feature and node.gain == pytest.approx(gain, rel=1e-6, abs=1e-6)
    _same(tree, left, node.left)
    _same(tree, right, node.right)


def _data(seed, n=60, classes=3, missing=True):
    rng = random.Random(seed)
    values = [None, math.nan, *range(6)] if missing else range(6)
    rows = [[None if (v := rng.choice(values)) is None else float(v) for _ in range(3)] for _ in range(n)]
    labels = [min(classes - 1, int((r[0] or 0) > 2 if not math.isnan(r[0] or 0) else 0) + rng.randrange(2)) for r in rows]
    return rows, labels


@pytest.mark.parametrize(
    "seed, classes, options",
    [
        (1, 3, dict(eta=0.3, max_depth=3, rounds=3)),
        (2, 2, dict(eta=0.2, max_depth=4, rounds=3, gamma=0.5, min_child_weight=2.0)),
        (3, 4, dict(max_depth=2, rounds=2, gamma=0.1, min_child_weight=0.0, reg_lambda=0.5)),
        (4, 2, dict(max_depth=0, rounds=2)),
        (5, 3, dict(max_depth=2, rounds=1, min_child_weight=1000.0)),
    ],
)
def test_trees_against_brute_force(spark, seed, classes, options):
    params = BoostingParams(**options)
    rows, labels = _data(seed, classes=classes)
    df = spark.createDataFrame(list(zip(rows, labels)), "features array<double>, label int")
    forest = train_forest(df, classes, params, partition_bytes=200)
    trees = 1 if classes == 2 else classes
    for r, round_ in enumerate(forest):
        pairs = _derivatives(_margins(forest[:r], rows, trees), labels)
        for k, tree in enumerate(round_):
            _same(tree, _grow(rows, pairs[k], list(range(len(rows))), 0, params))
    scored = BoostedTrees(tuple(map(tuple, forest)), classes).transform(df).collect()
    for row, margins in zip(scored, _margins(forest, [r["features"] for r in scored], trees)):
        full = margins if classes > 2 else np.array([0.0, margins[0]])
        powers = np.exp(full - full.max())
        assert row["probabilities"] == pytest.approx(list(powers / powers.sum()), abs=1e-9)
        assert row["prediction"] == int(np.argmax(row["probabilities"]))


def test_trees_do_not_depend_on_partitions(spark):
    rows, labels = _data(7, 400)
    df = spark.createDataFrame(list(zip(rows, labels)), "features array<double>, label int")
    params = BoostingParams(max_depth=3, rounds=2, subsample=0.6)
    one, many = (train_forest(d, 3, params, size) for d, size in ((df, 1 << 20), (df.repartition(5), 300)))
    assert one == many
    other = train_forest(df, 3, BoostingParams(max_depth=3, rounds=2, subsample=0.6, seed=1), 300)
    assert other != one


def test_rounds_learn_from_a_share_of_the_rows():
    keys = np.arange(20_000, dtype=np.int64) * 7919
    params = BoostingParams(subsample=0.8)
    first, second = (boosting._sampled(keys, r, params) for r in (0, 1))
    assert 0.78 < first.mean() < 0.82 and 0.6 < (first & second).mean() < 0.68


def test_split_search_takes_the_smallest_of_equal_gains(spark):
    cells = [(0, 0, f, b, g * UNIT, UNIT) for f in (0, 1) for b, g in ((0, -1), (1, 0), (2, 1))]
    cells += [(1, 4, 0, 0, UNIT, UNIT)]
    found = best_splits(spark.createDataFrame(cells, boosting._HISTOGRAM), BoostingParams(min_child_weight=1.0)).collect()
    by_node = {(r["tree"], r["node"]): r for r in found}
    best = by_node[0, 0]
    assert (best["feature"], best["bin"]) == (0, 0) and best["gain"] == pytest.approx(1 / 2 + 1 / 3)
    assert (best["g"], best["h"], best["gl"], best["hl"]) == (0, 3 * UNIT, -UNIT, UNIT)
    assert by_node[1, 4]["gain"] is None and by_node[1, 4]["g"] == UNIT


def test_many_values_are_cut_at_quantiles(spark):
    df = spark.range(20_000).select(F.array(F.col("id").cast("double"), F.lit(5.0), F.col("id") % 3.0).alias("features"))
    edges = boosting.bin_edges(df, 3, 64)
    assert 40 < len(edges[0]) <= 63 and edges[0] == sorted(set(edges[0]))
    assert max(b - a for a, b in zip(edges[0], edges[0][1:])) < 20_000 / 64 * 2
    assert edges[1:] == [[], [1.0, 2.0]]


def test_odd_rows(spark):
    schema = "features array<double>, label int"
    rows = [([1.0, None], 0), ([2.0, math.inf], 1), ([3.0, -math.inf], 1), ([math.nan, 0.0], 0), ([1.0, 1.0], None), ([1.0, 1.0], 7)]
    forest = train_forest(spark.createDataFrame(rows * 10, schema), 2, BoostingParams(max_depth=2, rounds=2))
    scored = BoostedTrees(tuple(map(tuple, forest)), 2).transform(spark.createDataFrame(rows, schema)).collect()
    assert [r["prediction"] for r in scored][:4] == [0.0, 1.0, 1.0, 0.0]
    empty = train_forest(spark.createDataFrame([], schema), 3, BoostingParams(rounds=2))
    assert empty == [[(Node(0.0),)] * 3] * 2
    with pytest.raises(ValueError):
        BoostingParams(bins=300)
