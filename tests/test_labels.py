import random
from collections import defaultdict
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.operators.ranking import top_k_per_group
from ledgerloom.plans import labels

ROWS = "image_id string, response long, tag string, confidence double, seq long"
RESPONSES = f"image_id string, labels {labels.LABELS_TYPE}, seq long"


def test_listing_keeps_the_surest_above_the_threshold(spark):
    found = [(f"l{i:02}", 95.0 + i / 10) for i in range(12)] + [("low", 94.9)]
    df = spark.createDataFrame([("a", found, 1), ("b", [], 2), ("c", None, 3), ("d", [("low", 1.0)], 4)], RESPONSES)
    rows = [tuple(r) for r in labels.label_listing(df).orderBy("rank").collect()]
    assert rows == [("a", n + 1, f"l{11 - n:02}", 95.0 + (11 - n) / 10) for n in range(10)]


def test_equal_confidences_are_ordered_by_name(spark):
    df = spark.createDataFrame([("a", [("z", 99.0), ("b", 99.0), ("m", 99.5)], 1)], RESPONSES)
    best = df.select(labels.best_labels(F.col("labels"), 2, 96.0)).first()[0]
    assert [tuple(x) for x in best] == [("m", 99.5), ("b", 99.0)]


def test_table_threshold_is_included_and_conf_is_decimal(spark):
    df = spark.createDataFrame([("a", 1, "t", 96.0, 1), ("a", 1, "u", 95.999, 2)], ROWS)
    table = labels.label_table(df)
    assert table.schema["conf"].dataType.simpleString() == "decimal(38,18)"
    assert [tuple(r) for r in table.collect()] == [("a", "t", Decimal("96"), 1)]


def test_table_against_brute_force_with_a_hot_image(spark):
    random.seed(1)
    data = [
        ("hot" if random.random() < 0.5 else f"i{random.randrange(20)}", i // 500, f"t{random.randrange(8)}",
         float(random.randrange(90, 101)), i)
        for i in range(2000)
    ]
    per_response = defaultdict(list)
    for row in data:
        if row[3] >= 96:
            per_response[row[:2]].append(row)
    kept = [row for found in per_response.values() for row in sorted(found, key=lambda r: (-r[3], r[2], r[4]))[:5]]
    expected = {(row[0], row[2]): (row[3], row[4]) for row in sorted(kept, key=lambda r: r[4])}
    actual = labels.label_table(spark.createDataFrame(data, ROWS).repartition(4))
    assert {(r["image_id"], r["tag"]): (float(r["conf"]), r["seq"]) for r in actual.collect()} == expected


def test_hot_images_are_cut_before_the_shuffle(spark):
    plan = labels.label_items(spark.createDataFrame([("a", 1, "t", 99.0, 1)], ROWS))._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_response_items(spark):
    df = spark.createDataFrame([("a", [(f"t{i}", 96.0 + i / 2) for i in range(8)], 9)], RESPONSES)
    rows = sorted(tuple(r) for r in labels.response_items(df).collect())
    assert rows == [("a", f"t{i}", Decimal(str(96 + i / 2)), 9) for i in range(3, 8)]


def test_many_labels_per_image(spark):
    data = [("hot", 1, f"t{i}", float(i), i) for i in range(1500)] + [("cold", 1, "t", 99.0, 1)]
    df = spark.createDataFrame(data, ROWS)
    kept = labels.label_items(df, max_labels=1200, min_confidence=100.0)
    assert sorted(r["seq"] for r in kept.collect()) == list(range(300, 1500))


def test_a_third_of_all_rows_on_one_image(spark):
    data = [("hot" if i % 3 == 0 else f"i{i}", 1, f"t{i:05}", 96.0 + i % 4, i) for i in range(6000)]
    kept = labels.label_items(spark.createDataFrame(data, ROWS).repartition(8))
    found = kept.where("image_id = 'hot'").collect()
    best = sorted((r for r in data if r[0] == "hot"), key=lambda r: (-r[3], r[2]))[:5]
    assert sorted(r["seq"] for r in found) == sorted(r[4] for r in best)


def test_more_ranks_than_spark_pushes_down_and_a_map_column(spark):
    rows = [("g", i, {"k": str(i)}) for i in range(1500)]
    df = spark.createDataFrame(rows, "name string, value long, tags map<string,string>")
    kept = top_k_per_group(df, 1001, ["name"], [F.col("value").desc()], ["value"])
    assert sorted(r["value"] for r in kept.collect()) == list(range(499, 1500))


def test_items_do_not_depend_on_batches(spark):
    """Eight labels of one image in two responses: the same items in one batch and in two."""
    data = [("a", i // 4, f"t{i}", 99.0 - i / 10, i) for i in range(8)]
    whole = labels.label_items(spark.createDataFrame(data, ROWS), max_labels=3).collect()
    parts = [labels.label_items(spark.createDataFrame(data[i : i + 4], ROWS), max_labels=3).collect() for i in (0, 4)]
    assert sorted(whole) == sorted(parts[0] + parts[1]) and len(whole) == 6
