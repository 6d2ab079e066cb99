"""The registered queries against their SQL twins, and their plans."""

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import compare
import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
LLM = re.compile(r"op\d+_|pipeline$")  # tested in tests/llm

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def connection():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(n for n in driver.queries() if not LLM.match(n)))
def test_same_rows_as_sql(spark, connection, name):
    assert compare.difference(spark, connection, FOLDER, name, driver.oracle_sql()[name]) is None


def test_every_query_has_a_twin():
    assert not [n for n in set(driver.queries()) - set(driver.oracle_sql()) if not LLM.match(n)]
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_the_period_of_a_stored_table_is_a_partition_filter(spark):
    for name in ("stored_cost_by_service", "stored_tagging_distribution", "stored_current_period"):
        assert re.search(r"PartitionFilters: \[[^\]]*bill_billing_period_start_date", _plan(spark, name))


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def _plan(spark, name):
    return driver.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


REPORTS = sorted(
    name
    for name in driver.queries()
    if re.match("cost|daily|reservation|savings|usage_and|tag|untagged|expensive|service|month_|week", name)
)


@pytest.mark.parametrize("name", REPORTS)
def test_reports_run_without_python_or_cross_joins(spark, name):
    plan = _plan(spark, name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "CollectLimit", "SinglePartition"):
        if operator == "SinglePartition" and name.startswith(("tagging_summary", "month_over_month")):
            continue  # one row from partial sums
        assert operator not in plan


@pytest.mark.parametrize("name", sorted(n for n in REPORTS if not n.endswith("_all_periods")))
def test_the_dates_reach_the_scan(spark, name):
    scans = [s for s in _plan(spark, name).splitlines() if "lineitem.parquet" in s]
    assert scans
    for scan in scans:
        assert "GreaterThanOrEqual(l_shipdate" in scan and "LessThan(l_shipdate" in scan


def test_scans_read_only_the_columns_in_use(spark):
    (scan,) = [s for s in _plan(spark, "cost_by_region").splitlines() if "lineitem.parquet" in s]
    schema = re.search(r"ReadSchema: struct<(.*?)>", scan)[1]
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_suppkey", "l_extendedprice", "l_returnflag", "l_shipdate"}


def test_month_over_month_reads_one_table(spark):
    plan = _plan(spark, "month_over_month")
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_small_results_are_not_sorted_as_a_whole(spark):
    assert "TakeOrderedAndProject" in _plan(spark, "cost_by_service_all_periods")
    assert "TakeOrderedAndProject" in _plan(spark, "week_over_week")
