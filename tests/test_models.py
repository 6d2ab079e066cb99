import json
import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.arrays import parse_matrix, softmax
from ledgerloom.plans import models

PARAMS = {**models.LOCAL_PARAMS, "rounds": 4}


@pytest.fixture(scope="module")
def flowers(spark):
    """Three classes that the first two features tell apart."""
    noise = [(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(100)) / 100.0) for i in range(4)]
    label = (F.col("id") % 3).cast("int")
    features = F.array(noise[0] + label, noise[1] - label, noise[2], noise[3])
    return spark.range(300).select("id", features.alias("features"), label.alias("label"))


@pytest.fixture(scope="module")
def model(flowers):
    return models.train_boosted_trees(flowers, 3, params=PARAMS)


def test_separable_classes_are_learnt(flowers, model):
    scored = model.transform(flowers)
    metrics = models.evaluate(scored).first()
    assert metrics["rows"] == 300 and metrics["accuracy"] > 0.95 and metrics["loss"] < 0.7
    bad = scored.where(
        (F.abs(F.aggregate("probabilities", F.lit(0.0), lambda a, b: a + b) - 1) > 1e-9)
        | (F.size("probabilities") != 3)
        | ~F.col("prediction").isin(0.0, 1.0, 2.0)
    )
    assert bad.isEmpty()


def test_saved_models_score_the_same(spark, flowers, model, tmp_path):
    for _ in range(2):
        model.save(spark, str(tmp_path / "m"))
    loaded = models.load_model(spark, str(tmp_path / "m"), 3)
    assert loaded == model
    with pytest.raises(ValueError, match="3 classes"):
        models.load_model(spark, str(tmp_path / "m"), 2)
    before = model.transform(flowers).select("id", "probabilities", "prediction")
    after = loaded.transform(flowers).select("id", "probabilities", "prediction")
    assert sorted(before.collect()) == sorted(after.collect())


def test_two_classes_take_one_tree_a_round(spark, flowers, tmp_path):
    two = flowers.withColumn("label", (F.col("label") == 2).cast("int"))
    model = models.train_boosted_trees(two, 2, params=PARAMS)
    assert [len(trees) for trees in model.forest] == [1] * 4
    model.save(spark, str(tmp_path / "m"))
    assert models.load_model(spark, str(tmp_path / "m"), 2) == model
    assert models.evaluate(model.transform(two)).first()["accuracy"] > 0.95


def test_the_cloud_setup_learns(flowers):
    two = flowers.withColumn("label", (F.col("label") == 2).cast("int"))
    model = models.train_boosted_trees(two, 2, params={**models.CLOUD_PARAMS, "rounds": 4}, partition_bytes=2000)
    assert (models.CLOUD_PARAMS["gamma"], models.CLOUD_PARAMS["min_child_weight"]) == (4.0, 6.0)
    assert models.evaluate(model.transform(two)).first()["accuracy"] > 0.95


def test_requests_are_scored_row_by_row(spark, flowers, model):
    sample = [r["features"] for r in flowers.orderBy("id").limit(4).collect()]
    bodies = [(1, json.dumps({"data": sample[:3]})), (2, json.dumps({"data": [sample[3]]})), (3, "{broken"), (4, '{"data": []}')]
    requests = spark.createDataFrame(bodies, "id int, body string")
    scored = sorted(tuple(r) for r in models.score_requests(requests, model, "id").collect())
    assert [(r[0], r[1]) for r in scored] == [(1, 0), (1, 1), (1, 2), (2, 0)]
    assert [r[2] for r in scored] == [0.0, 1.0, 2.0, 0.0]
    assert all(set(r[3]) <= {0.0, 1.0} for r in scored)


def test_parse_matrix_and_rounding(spark):
    df = spark.createDataFrame([('{"data": [[1, 2.5], [3e2, -4]]}',)], "body string")
    assert df.select(parse_matrix(F.col("body"))).first()[0] == [[1.0, 2.5], [300.0, -4.0]]
    halves = spark.sql("select transform(array(0.5D, 1.5D, 2.5D), x -> bround(x))").first()[0]
    assert halves == [0.0, 2.0, 2.0]


def test_softmax_of_large_scores(spark):
    df = spark.createDataFrame([([1000.0, 1000.0, -1000.0],)], "s array<double>")
    assert df.select(softmax(F.col("s"))).first()[0] == [0.5, 0.5, 0.0]


def test_evaluate_by_hand(spark):
    rows = [(0, [0.5, 0.5], 0.0), (1, [1.0, 0.0], 0.0)]
    df = spark.createDataFrame(rows, "label int, probabilities array<double>, prediction double")
    metrics = models.evaluate(df).first()
    assert metrics["accuracy"] == 0.5
    assert math.isclose(metrics["loss"], (math.log(2) - math.log(1e-15)) / 2)


def test_training_rows_are_bounded_and_the_same_each_time(spark):
    df = spark.range(4000).selectExpr("array(CAST(id AS double)) AS features", "id % 2 AS label")
    one, two = (sorted(r[0][0] for r in models.bounded_sample(d, 400).select("features").collect()) for d in (df, df.repartition(3)))
    assert one == two and 300 < len(one) < 500
    assert models.bounded_sample(df, None).count() == models.bounded_sample(df, 4000).count() == 4000
