"""Week-over-week cost of resources."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import cost_trend, percent_change
from ledgerloom.operators.filters import dates_between, is_net, non_empty
from ledgerloom.operators.ranking import top_k
from ledgerloom.schema import COST, LINE_TYPE, REGION, RESOURCE, SERVICE, USAGE_START, reads


@dataclass(frozen=True)
class Weeks:
    """Two spans of days to compare. A span ends at midnight of its last day."""

    current_start: dt.date
    current_end: dt.date
    previous_start: dt.date
    previous_end: dt.date

    def __post_init__(self):
        if not self.previous_start <= self.previous_end < self.current_start <= self.current_end:
            raise ValueError("the previous week must end before the current week starts")


def _used(items: DataFrame, weeks: Weeks) -> DataFrame:
    return non_empty(items.where(dates_between(USAGE_START, weeks.previous_start, weeks.current_end)), RESOURCE)


@reads(USAGE_START, LINE_TYPE, RESOURCE, COST)
def weekly_totals(items: DataFrame, weeks: Weeks, k: int | None = 20) -> DataFrame:
    """Net cost of each resource in both weeks and its change; the k largest changes."""

    def net_cost_between(first, last):
        cost = F.when(dates_between(USAGE_START, first, last) & is_net(), F.col(COST))
        return F.coalesce(F.sum(cost), F.lit(0))

    totals = (
        _used(items, weeks)
        .groupBy(F.col(RESOURCE).alias("resource_id"))
        .agg(
            net_cost_between(weeks.previous_start, weeks.previous_end).alias("prev_week_cost"),
            net_cost_between(weeks.current_start, weeks.current_end).alias("current_week_cost"),
        )
        .where((F.col("current_week_cost") > 0) | (F.col("prev_week_cost") > 0))
        .withColumn("week_over_week_change", F.col("current_week_cost") - F.col("prev_week_cost"))
    )
    return totals if k is None else top_k(totals, k, "week_over_week_change", ["resource_id"])


@reads(USAGE_START, RESOURCE, SERVICE, REGION)
def with_places(totals: DataFrame, items: DataFrame, weeks: Weeks, k: int | None = 20) -> DataFrame:
    """A row per total and (service, region) its resource was seen in, credits included."""
    places = _used(items, weeks).select(
        F.col(RESOURCE).alias("resource_id"), F.col(SERVICE).alias("service"), F.col(REGION).alias("region")
    )
    current, previous = F.col("current_week_cost"), F.col("prev_week_cost")
    rows = (
        places.join(totals, "resource_id")
        .distinct()
        .select(
            "resource_id",
            "service",
            "region",
            "prev_week_cost",
            "current_week_cost",
            "week_over_week_change",
            percent_change(current, previous).alias("percentage_change"),
            cost_trend(current, previous).alias("cost_trend"),
        )
    )
    return top_k(rows, k, "week_over_week_change", ["resource_id", "service", "region"])


@reads(*weekly_totals.columns, SERVICE, REGION)
def week_over_week(items: DataFrame, weeks: Weeks, k: int | None = 20) -> DataFrame:
    """Resources by growth of their cost from the previous week to the current one.

    A row per (resource, service, region) seen from the previous start to the
    current end; the costs are those of the whole resource, net of credits and
    refunds, and repeat on each of its rows.

    The totals take one aggregate per resource, combined map-side. As the order
    depends on the resource only, the first k rows belong to the first k
    resources, so only those are looked up in the table again, by a join that
    Spark plans from the size it finds: no group is gathered in one task, and
    for a small k the table is not shuffled. Without a k all rows come back.
    """
    return with_places(weekly_totals(items, weeks, k), items, weeks, k)
