import csv
import glob

import pytest
from conftest import APRIL, MAY
from pyspark.sql import functions as F

from ledgerloom.functions.tags import tag_count, tags_text
from ledgerloom.plans import tagging

KEY = "owner"


@pytest.fixture
def tagged(make_items):
    return make_items(
        {"resource": "both", "tags": {"owner": "ann", "team": "x"}, "cost": 1},
        {"resource": "both", "tags": {"team": "x"}, "cost": 2},
        {"resource": "other", "tags": {"team": "y"}, "cost": 4},
        {"resource": "blank", "tags": {"owner": ""}, "cost": 8},
        {"resource": "none", "tags": {}, "cost": 16},
        {"resource": "null", "tags": None, "cost": 32},
        {"resource": "my-management-box", "tags": {}, "cost": 64},
        {"resource": "an-overhead", "tags": {}, "cost": 128},
        {"resource": "", "tags": {"owner": "ann"}, "cost": 256},
        {"resource": "refunded", "tags": {"owner": "bob"}, "cost": 512, "type": "Refund"},
        {"resource": "taxed", "tags": {"owner": "bob"}, "cost": 1024, "type": "Tax"},
        {"resource": "old", "tags": {"owner": "bob"}, "cost": 2048, "period": APRIL},
    )


def test_cost_by_tag(tagged, rows):
    assert rows(tagging.cost_by_tag(tagged, KEY, MAY)) == [("bob", 1024.0), ("ann", 257.0)]
    assert rows(tagging.cost_by_tag(tagged, "missing", MAY)) == []


def test_untagged_resources_leave_out_null_maps(tagged, rows):
    found = rows(tagging.untagged_resources(tagged, MAY))
    assert [(r[1], r[3]) for r in found] == [("an-overhead", 128.0), ("my-management-box", 64.0), ("none", 16.0)]
    assert [(r[1], r[6]) for r in rows(tagging.expensive_untagged(tagged, MAY))] == [("none", 16.0)]


def test_untagged_resources_need_a_cost(make_items, rows):
    items = make_items(
        {"resource": "free", "cost": 0}, {"resource": "credit", "cost": -1}, {"resource": "paid", "cost": "0.01"}
    )
    assert [r[1] for r in rows(tagging.untagged_resources(items, MAY))] == ["paid"]


def test_tag_inventory_counts_a_row_under_each_tag(tagged, rows):
    assert rows(tagging.tag_inventory(tagged, MAY)) == [
        ("owner", "bob", 1, 1024.0),
        ("owner", "ann", 1, 1.0),
        ("team", "y", 1, 4.0),
        ("team", "x", 1, 3.0),
    ]


def test_tagging_status(tagged, rows):
    assert rows(tagging.tagging_status_by_service(tagged, KEY, MAY)) == [
        ("compute", "Tagged", "Has Tag Key", 1, 1.0),
        ("compute", "Tagged", "Missing Tag Key", 3, 14.0),
        ("compute", "Untagged", "Missing Tag Key", 4, 240.0),
    ]


def test_distribution(tagged, rows):
    (row,) = rows(tagging.tagging_distribution(tagged, KEY, MAY))
    assert row == (
        "compute", 5, 63.0,
        3, 60.0, 15.0, 23.81,
        2, 40.0, 48.0, 76.19,
        1, 20.0, 3.0, 4.76,
    )


def test_tagged_and_untagged_make_the_total(tagged):
    report = tagging.tagging_distribution(tagged, KEY, MAY)
    odd = report.where(
        (F.col("tagged_resources") + F.col("untagged_resources") != F.col("total_resources"))
        | (F.col("tagged_cost") + F.col("untagged_cost") != F.col("total_cost"))
    )
    assert odd.isEmpty()


def test_inventory_of_one_key_equals_cost_by_tag(tagged, rows):
    with_resource = tagged.where(F.col("line_item_resource_id") != "")
    inventory = tagging.tag_inventory(with_resource, MAY).where(F.col("tag_key") == KEY)
    assert sorted((r[1], r[3]) for r in rows(inventory)) == sorted(rows(tagging.cost_by_tag(with_resource, KEY, MAY)))


def test_a_service_without_cost_has_no_cost_percentage(make_items, rows):
    items = make_items({"cost": 5}, {"cost": -5, "resource": "r2", "tags": {"owner": "a"}})
    (row,) = rows(tagging.tagging_distribution(items, KEY, MAY))
    assert row[1:7] == (2, 0.0, 1, 50.0, -5.0, None)
    (summary,) = rows(tagging.tagging_summary(items, KEY, MAY))
    assert summary == (2, 0.0, 1, -5.0, 1, 5.0, 50.0, 0.0, 50.0, 100.0)


def test_summary_without_rows(make_items, rows):
    items = make_items({"period": APRIL})
    assert rows(tagging.tagging_summary(items, KEY, MAY)) == [(0, 0.0, 0, 0.0, 0, 0.0, 0.0, 0.0, 100.0, 100.0)]


def test_resource_detail(make_items, rows):
    items = make_items(
        {"tags": {"b": "2", "a": "1"}, "cost": 1},
        # The same map in another order is the same group.
        {"tags": {"a": "1", "b": "2"}, "cost": 2},
        {"tags": {"a": "1", "b": "2"}, "cost": 4, "usage_type": "disk"},
        {"resource": "r2", "tags": {"owner": "ann"}, "product": {}, "cost": 8},
        {"resource": "r3", "tags": None, "cost": 16},
        {"resource": "r4", "service": "other"},
        {"resource": "management", "cost": 5},
    )
    report = tagging.service_resource_detail(items, "compute", KEY, MAY)
    assert report.schema["tags"].dataType.simpleString() == "map<string,string>"
    assert rows(report.withColumn("tags", tags_text(F.col("tags")))) == [
        ("r2", None, "owner=ann", None, None, "Tagged", 1, "Yes", "ann", 8.0),
        ("r1", "Box", "a=1,b=2", "m1", "north", "Tagged", 2, "No", None, 4.0),
        ("r1", "Box", "a=1,b=2", "m1", "north", "Tagged", 2, "No", None, 3.0),
        ("r3", "Box", None, "m1", "north", "Untagged", None, "No", None, 16.0),
    ]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_tag_count_of_a_null_map_is_null(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.sql("select cast(null as map<string,string>) as m")
        assert df.select(tag_count(F.col("m"))).first()[0] is None
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def _csv(folder):
    rows = []
    for path in sorted(glob.glob(f"{folder}/*.csv")):
        with open(path, newline="") as f:
            rows += list(csv.DictReader(f))
    return rows


def test_monthly_report_files(tagged, tmp_path):
    written = tagging.monthly_tagging_report(tagged, KEY, MAY, str(tmp_path / "out"))
    assert sorted(written) == ["expensive_untagged", "summary", "tagged_vs_untagged"]
    (service,) = _csv(written["tagged_vs_untagged"])
    assert service["total_cost"] == "63.00" and service["tagged_cost_percent"] == "23.81"
    (resource,) = _csv(written["expensive_untagged"])
    assert (resource["resource_id"], resource["cost"]) == ("none", "16.00")
    (summary,) = _csv(written["summary"])
    assert summary["untagged_resources_percent"] == "40.00" and summary["tagged_resources_percent"] == "60.0"


def test_monthly_report_skips_empty_parts_and_shows_missing_values(make_items, tmp_path):
    items = make_items({"service": None, "tags": {"owner": "a"}})
    written = tagging.monthly_tagging_report(items, KEY, MAY, str(tmp_path / "out"))
    assert sorted(written) == ["summary", "tagged_vs_untagged"]
    assert _csv(written["tagged_vs_untagged"])[0]["service"] == "N/A"
