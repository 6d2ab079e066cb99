"""Cost reports: by service, instance type, resource, day, region, operation; months compared.

`items` is a cost table with the columns of `ledgerloom.schema`. `period` is a
billing period (first of the month), several, or None for the whole table.
Amounts come back as decimals; `money_as_double` turns them into doubles.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.filters import in_period, is_net, net_of_credits, non_empty, of_service
from ledgerloom.operators.ranking import ascending, descending, top_k
from ledgerloom.schema import (
    COST,
    INSTANCE_TYPE,
    LINE_TYPE,
    OPERATION,
    PERIOD,
    PLAN,
    PLAN_COMMITMENT,
    PLAN_COST,
    PLAN_RATE,
    PLAN_UPFRONT,
    PLAN_USED,
    REGION,
    RESERVATION,
    RESERVATION_COST,
    RESERVATION_UNUSED_RECURRING,
    RESERVATION_UNUSED_UPFRONT,
    RESOURCE,
    SERVICE,
    USAGE_AMOUNT,
    USAGE_START,
    USAGE_TYPE,
    reads,
)


def _total(column: str, alias: str):
    return F.sum(column).alias(alias)


def _net(items: DataFrame, period) -> DataFrame:
    return net_of_credits(in_period(items, period))


@reads(PERIOD, SERVICE, LINE_TYPE, COST)
def cost_by_service(items: DataFrame, period=None, k: int | None = 10) -> DataFrame:
    costs = (
        _net(items, period)
        .groupBy(F.col(PERIOD).alias("billing_period"), F.col(SERVICE).alias("service"))
        .agg(_total(COST, "total_cost"))
    )
    return top_k(costs, k, "total_cost", ["billing_period", "service"])


@reads(PERIOD, SERVICE, LINE_TYPE, USAGE_TYPE, INSTANCE_TYPE, COST)
def cost_by_instance_type(items: DataFrame, service: str, period=None, k: int | None = 20) -> DataFrame:
    costs = (
        non_empty(of_service(_net(items, period), service), INSTANCE_TYPE)
        .groupBy(
            F.col(PERIOD).alias("billing_period"),
            F.col(USAGE_TYPE).alias("usage_type"),
            F.col(INSTANCE_TYPE).alias("instance_type"),
        )
        .agg(_total(COST, "cost"))
    )
    return top_k(costs, k, "cost", ["billing_period", "usage_type", "instance_type"])


@reads(PERIOD, SERVICE, LINE_TYPE, RESOURCE, USAGE_TYPE, COST)
def cost_by_resource_usage(items: DataFrame, service: str, period=None, k: int | None = 20) -> DataFrame:
    costs = (
        non_empty(of_service(_net(items, period), service), RESOURCE)
        .groupBy(F.col(RESOURCE).alias("resource_id"), F.col(USAGE_TYPE).alias("usage_type"))
        .agg(_total(COST, "cost"))
    )
    return top_k(costs, k, "cost", ["resource_id", "usage_type"])


@reads(PERIOD, LINE_TYPE, USAGE_START, COST)
def daily_cost(items: DataFrame, period=None) -> DataFrame:
    """Cost per day of use, newest day first."""
    return (
        _net(items, period)
        .groupBy(F.to_date(USAGE_START).alias("usage_date"))
        .agg(_total(COST, "daily_cost"))
        .orderBy(*descending("usage_date"))
    )


@reads(PERIOD, LINE_TYPE, REGION, COST)
def cost_by_region(items: DataFrame, period=None) -> DataFrame:
    costs = _net(items, period).groupBy(F.col(REGION).alias("region")).agg(_total(COST, "cost"))
    return top_k(costs, None, "cost", ["region"])


@reads(PERIOD, LINE_TYPE, RESERVATION, RESERVATION_COST, RESERVATION_UNUSED_UPFRONT, RESERVATION_UNUSED_RECURRING)
def reservation_costs(items: DataFrame, period=None) -> DataFrame:
    """Effective cost and unused fees of each reservation."""
    costs = (
        non_empty(_net(items, period), RESERVATION)
        .groupBy(F.col(PERIOD).alias("billing_period"), F.col(RESERVATION).alias("reservation_arn"))
        .agg(
            _total(RESERVATION_COST, "effective_cost"),
            _total(RESERVATION_UNUSED_UPFRONT, "unused_upfront_fee"),
            _total(RESERVATION_UNUSED_RECURRING, "unused_recurring_fee"),
        )
    )
    return top_k(costs, None, "effective_cost", ["billing_period", "reservation_arn"])


@reads(PERIOD, LINE_TYPE, PLAN, PLAN_COST, PLAN_COMMITMENT, PLAN_USED, PLAN_RATE, PLAN_UPFRONT)
def savings_plan_utilization(items: DataFrame, period=None) -> DataFrame:
    """Cost, commitment and use of each savings plan."""
    costs = (
        non_empty(_net(items, period), PLAN)
        .groupBy(F.col(PERIOD).alias("billing_period"), F.col(PLAN).alias("savings_plan_arn"))
        .agg(
            _total(PLAN_COST, "savings_plan_cost"),
            _total(PLAN_COMMITMENT, "commitment"),
            _total(PLAN_USED, "used_commitment"),
            _total(PLAN_RATE, "savings_plan_rate"),
            _total(PLAN_UPFRONT, "amortized_upfront"),
        )
    )
    return top_k(costs, None, "savings_plan_cost", ["billing_period", "savings_plan_arn"])


@reads(PERIOD, SERVICE, LINE_TYPE, USAGE_START, OPERATION, RESOURCE, USAGE_AMOUNT, COST)
def usage_and_cost_by_operation(items: DataFrame, service: str, period=None) -> DataFrame:
    return (
        of_service(_net(items, period), service)
        .groupBy(
            F.to_date(USAGE_START).alias("usage_date"),
            F.col(OPERATION).alias("operation"),
            F.col(RESOURCE).alias("resource_id"),
        )
        .agg(_total(USAGE_AMOUNT, "usage_amount"), _total(COST, "cost"))
        .orderBy(*descending("usage_date", "cost"), *ascending("operation", "resource_id"))
    )


@reads(PERIOD, LINE_TYPE, COST)
def month_over_month(items: DataFrame, current: dt.date, previous: dt.date) -> DataFrame:
    """One row: net cost of two periods and their difference; NULL costs on no items."""

    def net_cost_in(period):
        return F.sum(F.when((F.col(PERIOD) == F.lit(period)) & is_net(), F.col(COST)).otherwise(F.lit(0)))

    totals = in_period(items, [current, previous]).agg(
        net_cost_in(current).alias("current_cost"), net_cost_in(previous).alias("previous_cost")
    )
    return totals.select(
        F.lit(f"{current:%Y-%m}").alias("current_month"),
        F.lit(f"{previous:%Y-%m}").alias("previous_month"),
        "current_cost",
        "previous_cost",
        (F.col("current_cost") - F.col("previous_cost")).alias("cost_difference"),
    )
