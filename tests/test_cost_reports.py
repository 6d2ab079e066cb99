import datetime as dt

import pytest
from conftest import APRIL, MAY

from ledgerloom.operators.filters import current_period
from ledgerloom.plans import cost
from ledgerloom.schema import COST, COST_ITEM_SCHEMA, MONEY, PERIOD, exact_cast, money_as_double, normalise_costs
from ledgerloom.sources.catalog import register_table


def test_credits_refunds_and_missing_types_do_not_count(make_items, rows):
    items = make_items(
        {"cost": 5},
        {"cost": 7, "type": "Credit"},
        {"cost": 9, "type": "Refund"},
        {"cost": 11, "type": None},
        {"cost": 2, "type": "Tax"},
        {"cost": 100, "period": APRIL},
    )
    assert rows(cost.cost_by_service(items, MAY)) == [(MAY, "compute", 7.0)]


def test_top_k_breaks_ties_by_name(make_items, rows):
    items = make_items(*[{"service": s, "cost": 1} for s in "dbca"], {"service": "z", "cost": 2})
    assert [r[1] for r in rows(cost.cost_by_service(items, MAY, k=3))] == ["z", "a", "b"]


def test_all_periods_and_several_periods(make_items, rows):
    items = make_items({"cost": 1}, {"cost": 2, "period": APRIL}, {"cost": 4, "period": dt.date(2025, 3, 1)})
    assert len(rows(cost.cost_by_service(items))) == 3
    assert sorted(r[2] for r in rows(cost.cost_by_service(items, [MAY, APRIL]))) == [1.0, 2.0]


def test_empty_and_missing_text_is_left_out(make_items, rows):
    items = make_items(
        {"instance": "", "resource": "", "cost": 1},
        {"instance": None, "resource": None, "cost": 2},
        {"instance": "m2", "resource": "r2", "cost": 4},
        {"instance": "m2", "resource": "r2", "service": "other", "cost": 8},
    )
    assert rows(cost.cost_by_instance_type(items, "compute", MAY)) == [(MAY, "box", "m2", 4.0)]
    assert rows(cost.cost_by_resource_usage(items, "compute", MAY)) == [("r2", "box", 4.0)]


def test_daily_cost_newest_first(make_items, rows):
    items = make_items(
        {"used": dt.datetime(2025, 5, 2, 23, 59), "cost": 1},
        {"used": dt.datetime(2025, 5, 2), "cost": 2},
        {"used": dt.datetime(2025, 5, 3), "cost": 4},
    )
    assert rows(cost.daily_cost(items, MAY)) == [(dt.date(2025, 5, 3), 4.0), (dt.date(2025, 5, 2), 3.0)]


def test_region_and_operation(make_items, rows):
    items = make_items(
        {"region": "south", "operation": "scan", "cost": 3, "amount": 10},
        {"region": "north", "operation": "scan", "cost": 5, "amount": 20},
        {"region": None, "operation": "load", "cost": 4, "amount": 1, "resource": "r2"},
    )
    assert rows(cost.cost_by_region(items, MAY)) == [("north", 5.0), (None, 4.0), ("south", 3.0)]
    day = dt.date(2025, 5, 2)
    assert rows(cost.usage_and_cost_by_operation(items, "compute", MAY)) == [
        (day, "scan", "r1", 30.0, 8.0),
        (day, "load", "r2", 1.0, 4.0),
    ]


def test_reservations_and_plans_ignore_missing_measures(make_items, rows):
    items = make_items(
        {"reservation": "ri", "reservation_cost": 2, "unused_upfront": None, "unused_recurring": 1, "plan": "sp"},
        {"reservation": "ri", "reservation_cost": 3, "unused_upfront": 4, "unused_recurring": None, "plan": None},
        {"reservation": None, "reservation_cost": 9},
    )
    assert rows(cost.reservation_costs(items, MAY)) == [(MAY, "ri", 5.0, 4.0, 1.0)]
    assert rows(cost.savings_plan_utilization(items, MAY)) == [(MAY, "sp", None, None, None, None, None)]


def test_month_over_month(make_items, rows):
    items = make_items(
        {"cost": 5},
        {"cost": 9, "type": "Refund"},
        {"cost": 2, "period": APRIL},
        {"cost": 1, "period": APRIL, "type": None},
        {"cost": 50, "period": dt.date(2025, 3, 1)},
    )
    # A missing line type is in the table but counts 0.
    assert rows(cost.month_over_month(items, MAY, APRIL)) == [("2025-05", "2025-04", 5.0, 2.0, 3.0)]


def test_month_over_month_without_items_has_no_cost(make_items, rows):
    items = make_items({"period": dt.date(2020, 1, 1)})
    assert rows(cost.month_over_month(items, MAY, APRIL)) == [("2025-05", "2025-04", None, None, None)]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_large_amounts_stay_and_those_out_of_range_fail(spark, ansi):
    raw = spark.createDataFrame([(1_000_000.0,), (None,), (-123_456_789.25,)], f"{COST} double")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        found = [r[0] for r in money_as_double(normalise_costs(raw)).collect()]
        assert found == [1_000_000.0, None, -123_456_789.25]
        amounts = raw.selectExpr(exact_cast(COST, "decimal(18,2)") + " AS a")
        assert [None if r[0] is None else float(r[0]) for r in amounts.collect()] == found
        for odd in (1e30, float("nan")):
            broken = normalise_costs(spark.createDataFrame([(odd,)], f"{COST} double"))
            with pytest.raises(Exception, match="out of range"):
                broken.collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_the_current_month_is_a_period(spark, make_items):
    today = dt.date.today()
    items = make_items({"period": today.replace(day=1), "cost": "5"}, {"period": MAY, "cost": "7"})
    assert [r["total_cost"] for r in cost.cost_by_service(items, current_period()).collect()] == [5]


def test_normalise_costs_makes_sums_exact(spark):
    raw = spark.createDataFrame(
        [("2025-05-01", "compute", "Usage", 0.1), ("2025-05-01", "compute", "Usage", 0.2)],
        "bill_billing_period_start_date string, line_item_product_code string, "
        "line_item_line_item_type string, line_item_unblended_cost double",
    )
    items = normalise_costs(raw)
    assert items.schema["line_item_unblended_cost"].dataType == MONEY
    report = money_as_double(cost.cost_by_service(items, MAY))
    assert report.schema["total_cost"].dataType.simpleString() == "double"
    assert [tuple(r) for r in report.collect()] == [(MAY, "compute", 0.3)]


def test_reports_name_the_columns_they_read(make_items):
    items = make_items({})
    reports = {
        cost.cost_by_service: (),
        cost.cost_by_instance_type: ("compute",),
        cost.cost_by_resource_usage: ("compute",),
        cost.daily_cost: (),
        cost.cost_by_region: (),
        cost.reservation_costs: (),
        cost.savings_plan_utilization: (),
        cost.usage_and_cost_by_operation: ("compute",),
    }
    for report, args in reports.items():
        assert set(report.columns) <= set(COST_ITEM_SCHEMA.names)
        report(items.select(*report.columns), *args, period=MAY).collect()


@pytest.mark.parametrize("k, n", [(2, 2), (None, 4)])
def test_k_is_optional(make_items, rows, k, n):
    items = make_items(*[{"service": s} for s in "abcd"])
    assert len(rows(cost.cost_by_service(items, MAY, k=k))) == n


def test_a_stored_table_is_pruned_by_period_and_open_to_sql(spark, make_items, rows, tmp_path):
    path = str(tmp_path / "data")
    items = make_items({"cost": 1}, {"cost": 2, "period": APRIL}, {"cost": 4, "service": "disk"})
    items.write.partitionBy(PERIOD).parquet(path)
    table = spark.table(register_table(spark, path, "billing", "cur_"))
    report = cost.cost_by_service(table, MAY)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bill_billing_period_start_date" in plan
    assert rows(report) == [(MAY, "disk", 4.0), (MAY, "compute", 1.0)]
    by_sql = spark.sql(
        """SELECT bill_billing_period_start_date AS billing_period, line_item_product_code AS service,
             sum(line_item_unblended_cost) AS total_cost
           FROM billing.cur_data
           WHERE bill_billing_period_start_date = :period AND line_item_line_item_type NOT IN ('Credit', 'Refund')
           GROUP BY ALL ORDER BY total_cost DESC""",
        args={"period": MAY},
    )
    assert rows(by_sql) == rows(report)
