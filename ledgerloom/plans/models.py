"""Boosted trees: train, save, load, score, evaluate.

Scoring is built-in expressions: a CASE per tree, summed up to the margins of
the classes, which become probabilities by softmax.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.arrays import parse_matrix, softmax
from ledgerloom.plans.boosting import BoostingParams, Node, Tree, train_forest

# The local and the cloud training setups.
LOCAL_PARAMS = {"eta": 0.3, "max_depth": 3, "rounds": 20}
CLOUD_PARAMS = {"eta": 0.2, "max_depth": 5, "rounds": 100, "gamma": 4.0, "min_child_weight": 6.0, "subsample": 0.8}
CLOUD_CLASSES = 2

_SMALLEST_PROBABILITY = 1e-15
_FEATURES = "_present"


def _number(value: float) -> str:
    return f"{value!r}D" if math.isfinite(value) else f"double('{value}')"


def _tree_sql(tree: Tree, at: int = 0) -> str:
    """The value a tree gives to an array of features, of which missing ones are null."""
    node = tree[at]
    if node.feature < 0:
        return _number(node.value)
    left, right = _tree_sql(tree, node.left), _tree_sql(tree, node.right)
    # Nulls make the comparison null, so they go where it is not false.
    return f"CASE WHEN get({_FEATURES}, {node.feature}) >= {_number(node.threshold)} THEN {right} ELSE {left} END"


@dataclass(frozen=True)
class BoostedTrees:
    """The trees of each round: one per class, or one where there are two classes."""

    forest: tuple[tuple[Tree, ...], ...]
    classes: int

    def margins(self) -> Column:
        """The margins of the classes, from the column of features without missing values."""
        found = []
        for k in range(1 if self.classes == 2 else self.classes):
            values = [_tree_sql(trees[k]) for trees in self.forest]
            found.append(F.expr(f"aggregate(array({', '.join(values)}), 0D, (a, x) -> a + x)" if values else "0D"))
        return F.array(F.lit(0.0), *found) if self.classes == 2 else F.array(*found)

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Add `probabilities` (an array over the classes) and `prediction`."""
        present = F.transform(features, lambda x: F.when(~F.isnan(x.cast("double")), x.cast("double")))
        scored = df.withColumn(_FEATURES, present).withColumn("probabilities", softmax(self.margins()))
        best = F.array_position("probabilities", F.array_max("probabilities")) - 1
        scored = scored.withColumn("prediction", best.cast("double"))
        return scored.select(*df.columns, "probabilities", "prediction")

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the trees as a table of their nodes; replaces what is there."""
        rows = [
            (r, k, i, json.dumps(asdict(node)))
            for r, trees in enumerate(self.forest)
            for k, tree in enumerate(trees)
            for i, node in enumerate(tree)
        ]
        nodes = spark.createDataFrame(rows, "round int, tree int, node int, content string")
        nodes.withColumn("classes", F.lit(self.classes)).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str, classes: int) -> BoostedTrees:
    """Read a model that `BoostedTrees.save` wrote for this number of classes."""
    rows = spark.read.parquet(path).orderBy("round", "tree", "node").collect()  # as many as the trees have nodes
    if any(r["classes"] != classes for r in rows):
        raise ValueError(f"the model has {rows[0]['classes']} classes")
    forest: list[list[list[Node]]] = []
    for r in rows:
        if r["round"] == len(forest):
            forest.append([])
        if r["tree"] == len(forest[-1]):
            forest[-1].append([])
        forest[-1][-1].append(Node(**json.loads(r["content"])))
    return BoostedTrees(tuple(tuple(map(tuple, trees)) for trees in forest), classes)


# Labelled rows a model is fitted to, unless told otherwise.
TRAINING_ROWS = 50_000


def bounded_sample(df: DataFrame, rows: int | None) -> DataFrame:
    """About `rows` rows, the same ones for the same data; all if there are fewer or for None."""
    if rows is None:
        return df
    share = rows / max(1, df.count())
    if share >= 1:
        return df
    return df.where(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 30)) < int(share * (1 << 30)))


def train_boosted_trees(
    df: DataFrame,
    classes: int,
    features: str = "features",
    label: str = "label",
    params: dict | None = None,
    rows: int | None = TRAINING_ROWS,
    partition_bytes: int = 64 << 20,
) -> BoostedTrees:
    """Train on an array column of features and labels 0..classes-1; `params` are those of BoostingParams.

    Several classes are learnt together, through the softmax of their margins.
    Each level of a round reads the training rows, so they are bounded: about
    `rows` of them are taken by a hash, all for None. They are spread over
    partitions of `partition_bytes`, a byte a feature.
    """
    data = bounded_sample(df.select(F.col(features).cast("array<double>").alias("features"), F.col(label).alias("label")), rows)
    forest = train_forest(data, classes, BoostingParams(**(LOCAL_PARAMS if params is None else params)), partition_bytes)
    return BoostedTrees(tuple(map(tuple, forest)), classes)


def score_requests(requests: DataFrame, model: BoostedTrees, key: str, body: str = "body") -> DataFrame:
    """Score JSON bodies {"data": [[...], ...]}: one output row per matrix row.

    `result` holds the class probabilities, rounded half to even.
    """
    rows = requests.select(key, F.posexplode(parse_matrix(F.col(body))).alias("position", "features"))
    scored = model.transform(rows)
    rounded = F.transform("probabilities", lambda p: F.bround(p))
    return scored.select(key, "position", "prediction", rounded.alias("result"))


def evaluate(predictions: DataFrame, label: str = "label") -> DataFrame:
    """One row: number of rows, mean log loss and accuracy."""
    of_label = F.get("probabilities", F.col(label).cast("int"))
    loss = -F.log(F.greatest(of_label, F.lit(_SMALLEST_PROBABILITY)))
    hit = (F.col("prediction") == F.col(label)).cast("double")
    return predictions.agg(
        F.count(F.lit(1)).alias("rows"), F.avg(loss).alias("loss"), F.avg(hit).alias("accuracy")
    )
