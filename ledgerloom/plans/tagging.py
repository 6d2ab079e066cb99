"""Tagging compliance reports and the monthly report job."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import or_not_available, percent_of, share_percent, two_decimals
from ledgerloom.functions.tags import has_tag, is_tagged, tag_count, tag_value
from ledgerloom.operators.filters import (
    in_period,
    net_of_credits,
    non_empty,
    of_service,
    usage_only,
    without_marks,
)
from ledgerloom.operators.ranking import ascending, descending, top_k
from ledgerloom.schema import (
    COST,
    LINE_TYPE,
    PERIOD,
    PRODUCT,
    REGION,
    RESOURCE,
    SERVICE,
    TAGS,
    USAGE_TYPE,
    reads,
)
from ledgerloom.sinks.files import write_csv


@reads(PERIOD, LINE_TYPE, TAGS, COST)
def cost_by_tag(items: DataFrame, key: str, period=None) -> DataFrame:
    """Net cost per value of a tag; rows without the tag are left out."""
    costs = (
        net_of_credits(in_period(items, period))
        .select(tag_value(F.col(TAGS), key).alias("tag_value"), COST)
        .where(F.col("tag_value") != "")
        .groupBy("tag_value")
        .agg(F.sum(COST).alias("cost"))
    )
    return top_k(costs, None, "cost", ["tag_value"])


def _resource_usage(items: DataFrame, period) -> DataFrame:
    return non_empty(usage_only(in_period(items, period)), RESOURCE)


@reads(PERIOD, SERVICE, LINE_TYPE, RESOURCE, REGION, TAGS, COST)
def untagged_resources(items: DataFrame, period=None, k: int | None = 50) -> DataFrame:
    """Resources with an empty tag map, dearest first."""
    costs = (
        _resource_usage(items, period)
        .where(tag_count(F.col(TAGS)) == 0)
        .groupBy(
            F.col(SERVICE).alias("service"), F.col(RESOURCE).alias("resource_id"), F.col(REGION).alias("region")
        )
        .agg(F.sum(COST).alias("cost"))
        .where(F.col("cost") > 0)
    )
    return top_k(costs, k, "cost", ["service", "resource_id", "region"])


@reads(PERIOD, LINE_TYPE, RESOURCE, TAGS, COST)
def tag_inventory(items: DataFrame, period=None) -> DataFrame:
    """Resources and net cost of every (tag key, value); a row counts under each of its tags.

    Rows are summed up per resource and tag map first, so that a row per hour
    is not multiplied by its number of tags. Then two aggregates stand in for a
    distinct count: the one per resource is combined map-side, so a tag that a
    third of all rows carry stays spread out.
    """
    per_map = (
        non_empty(net_of_credits(in_period(items, period)), RESOURCE).groupBy(RESOURCE, TAGS).agg(F.sum(COST).alias("cost"))
    )
    per_resource = (
        per_map.select(F.explode(TAGS).alias("tag_key", "tag_value"), RESOURCE, "cost")
        .where(F.col("tag_value") != "")
        .groupBy("tag_key", "tag_value", RESOURCE)
        .agg(F.sum("cost").alias("cost"))
    )
    return (
        per_resource.groupBy("tag_key", "tag_value")
        .agg(F.count(F.lit(1)).alias("resource_count"), F.sum("cost").alias("total_cost"))
        .orderBy(*ascending("tag_key"), *descending("total_cost"), *ascending("tag_value"))
    )


@reads(PERIOD, SERVICE, LINE_TYPE, RESOURCE, TAGS, COST)
def tagging_status_by_service(items: DataFrame, key: str, period=None) -> DataFrame:
    """Resources and cost per service, tagged or not, with the tag key or not."""
    # The labels of the report.
    groups = ("service", "general_tagging_status", "specific_tag_status")
    per_resource = (
        _resource_usage(items, period)
        .groupBy(
            F.col(SERVICE).alias("service"),
            F.when(is_tagged(F.col(TAGS)), "Tagged").otherwise("Untagged").alias("general_tagging_status"),
            F.when(has_tag(F.col(TAGS), key), "Has Tag Key")
            .otherwise("Missing Tag Key")
            .alias("specific_tag_status"),
            F.col(RESOURCE),
        )
        .agg(F.sum(COST).alias("cost"))
    )
    return (
        per_resource.groupBy(*groups)
        .agg(F.count(F.lit(1)).alias("resource_count"), F.sum("cost").alias("total_cost"))
        .orderBy(*ascending(*groups))
    )


_DISTRIBUTION_COLUMNS = (PERIOD, SERVICE, LINE_TYPE, RESOURCE, TAGS, COST)
_DETAIL_COLUMNS = (PERIOD, SERVICE, LINE_TYPE, RESOURCE, REGION, USAGE_TYPE, TAGS, PRODUCT, COST)


def _distribution(flagged: DataFrame) -> DataFrame:
    """Counts, costs and percentages per service.

    `flagged` has service, resource_id, tagged, specific_tag and cost; it may be
    summed up beforehand, as both levels only take maxima and sums.
    """
    resources = flagged.groupBy("service", "resource_id").agg(
        F.bool_or("tagged").alias("tagged"),
        F.bool_or("specific_tag").alias("specific_tag"),
        F.sum("cost").alias("cost"),
    )

    def count_where(flag):
        return F.sum(F.when(flag, 1).otherwise(0))

    def cost_where(flag):
        return F.sum(F.when(flag, F.col("cost")).otherwise(F.lit(0)))

    totals = resources.groupBy("service").agg(
        F.count(F.lit(1)).alias("total_resources"),
        F.sum("cost").alias("total_cost"),
        count_where(F.col("tagged")).alias("tagged_resources"),
        cost_where(F.col("tagged")).alias("tagged_cost"),
        count_where(~F.col("tagged")).alias("untagged_resources"),
        cost_where(~F.col("tagged")).alias("untagged_cost"),
        count_where(F.col("specific_tag")).alias("resources_with_specific_tag"),
        cost_where(F.col("specific_tag")).alias("specific_tag_cost"),
    )

    def of_resources(column):
        return percent_of(F.col(column), F.col("total_resources"))

    def of_cost(column):
        return percent_of(F.col(column), F.col("total_cost"))

    report = totals.select(
        "service",
        "total_resources",
        "total_cost",
        "tagged_resources",
        of_resources("tagged_resources").alias("tagged_resources_percent"),
        "tagged_cost",
        of_cost("tagged_cost").alias("tagged_cost_percent"),
        "untagged_resources",
        of_resources("untagged_resources").alias("untagged_resources_percent"),
        "untagged_cost",
        of_cost("untagged_cost").alias("untagged_cost_percent"),
        "resources_with_specific_tag",
        of_resources("resources_with_specific_tag").alias("specific_tag_resources_percent"),
        "specific_tag_cost",
        of_cost("specific_tag_cost").alias("specific_tag_cost_percent"),
    )
    return top_k(report, None, "total_cost", ["service"])


@reads(*_DISTRIBUTION_COLUMNS)
def tagging_distribution(items: DataFrame, key: str, period=None) -> DataFrame:
    """Per service: how many resources, and how much cost, carry tags and the tag key."""
    tags = F.col(TAGS)
    flagged = without_marks(_resource_usage(items, period)).select(
        F.col(SERVICE).alias("service"),
        F.col(RESOURCE).alias("resource_id"),
        is_tagged(tags).alias("tagged"),
        has_tag(tags, key).alias("specific_tag"),
        F.col(COST).alias("cost"),
    )
    return _distribution(flagged)


@reads(*_DISTRIBUTION_COLUMNS)
def tagging_summary(items: DataFrame, key: str, period=None) -> DataFrame:
    """One row over all services: totals, and shares that are 0 without a total."""
    return summarise(tagging_distribution(items, key, period))


def summarise(distribution: DataFrame) -> DataFrame:
    """The grand totals of a tagging distribution."""
    names = (
        "total_resources",
        "total_cost",
        "tagged_resources",
        "tagged_cost",
        "untagged_resources",
        "untagged_cost",
    )
    totals = distribution.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names])
    resources = share_percent(F.col("tagged_resources"), F.col("total_resources"))
    cost = share_percent(F.col("tagged_cost"), F.col("total_cost"))
    return totals.select(
        *names,
        resources.alias("tagged_resources_percent"),
        cost.alias("tagged_cost_percent"),
        F.round(F.lit(100.0) - resources, 2).alias("untagged_resources_percent"),
        F.round(F.lit(100.0) - cost, 2).alias("untagged_cost_percent"),
    )


@reads(*_DETAIL_COLUMNS)
def service_resource_detail(items: DataFrame, service: str, key: str, period=None) -> DataFrame:
    """The resources of a service with their tags and cost.

    The usage type is a group key but no output column, so a resource shows up
    once per usage type. The other tag columns follow from the map and need no
    place among the group keys.
    """
    tags, product = F.col("tags"), F.col(PRODUCT)
    resources = (
        of_service(without_marks(_resource_usage(items, period)), service)
        .groupBy(
            F.col(RESOURCE).alias("resource_id"),
            F.col(USAGE_TYPE).alias("usage_type"),
            tag_value(product, "product_name").alias("product_name"),
            F.col(TAGS).alias("tags"),
            tag_value(product, "instance_type").alias("instance_type"),
            tag_value(product, "region").alias("region"),
        )
        .agg(F.sum(COST).alias("monthly_cost"))
    )
    # The labels of the report.
    return resources.select(
        "resource_id",
        "product_name",
        "tags",
        "instance_type",
        "region",
        F.when(is_tagged(tags), "Tagged").otherwise("Untagged").alias("tagging_status"),
        tag_count(tags).alias("tag_count"),
        F.when(has_tag(tags, key), "Yes").otherwise("No").alias("has_specific_tag"),
        tag_value(tags, key).alias("specific_tag_value"),
        "monthly_cost",
    ).orderBy(*ascending("tagging_status"), *descending("monthly_cost"), *ascending("resource_id"))


_EXPENSIVE_KEYS = ("service", "resource_id", "region", "instance_type", "product_name", "usage_type")


def _expensive(flagged: DataFrame, k: int | None) -> DataFrame:
    costs = (
        flagged.where("untagged").groupBy(*_EXPENSIVE_KEYS).agg(F.sum("cost").alias("cost")).where(F.col("cost") > 0)
    )
    return top_k(costs, k, "cost", _EXPENSIVE_KEYS)


def _flagged_usage(items: DataFrame, key: str | None, period) -> DataFrame:
    tags, product = F.col(TAGS), F.col(PRODUCT)
    specific = F.lit(False) if key is None else has_tag(tags, key)
    return without_marks(_resource_usage(items, period)).select(
        F.col(SERVICE).alias("service"),
        F.col(RESOURCE).alias("resource_id"),
        F.col(REGION).alias("region"),
        tag_value(product, "instance_type").alias("instance_type"),
        tag_value(product, "product_name").alias("product_name"),
        F.col(USAGE_TYPE).alias("usage_type"),
        is_tagged(tags).alias("tagged"),
        # A NULL map is not known to be untagged and stays out of the list.
        F.coalesce(tag_count(tags) == 0, F.lit(False)).alias("untagged"),
        specific.alias("specific_tag"),
        F.col(COST).alias("cost"),
    )


@reads(*_DETAIL_COLUMNS)
def expensive_untagged(items: DataFrame, period=None, k: int | None = 50) -> DataFrame:
    """As untagged_resources, without shared resources and with product details."""
    return _expensive(_flagged_usage(items, None, period), k)


def _rendered(report: DataFrame, amounts: tuple[str, ...]) -> DataFrame:
    return report.select(
        *[
            or_not_available(two_decimals(F.col(c)) if c in amounts else F.col(c)).alias(c)
            for c in report.columns
        ]
    )


@reads(*_DETAIL_COLUMNS)
def monthly_tagging_report(
    items: DataFrame, key: str, period: dt.date, out: str, k: int | None = 50
) -> dict[str, str]:
    """Write distribution, expensive untagged resources and summary as CSV under `out`.

    Costs have two decimals and missing values read N/A. Empty parts are not
    written. Returns the folder of each part written.

    The table is read once: its sums per resource and detail are kept while the
    parts are written, and so are the two reports made from them, which are
    looked at more than once.
    """
    keys = (*_EXPENSIVE_KEYS, "tagged", "untagged", "specific_tag")
    sums = _flagged_usage(items, key, period).groupBy(*keys).agg(F.sum("cost").alias("cost")).persist()
    distribution, expensive = _distribution(sums).persist(), _expensive(sums, k).persist()
    try:
        parts = {
            "tagged_vs_untagged": _rendered(
                distribution, ("total_cost", "tagged_cost", "untagged_cost", "specific_tag_cost")
            ),
            "expensive_untagged": _rendered(expensive, ("cost",)),
            "summary": _rendered(
                summarise(distribution),
                (
                    "total_cost",
                    "tagged_cost",
                    "untagged_cost",
                    "untagged_resources_percent",
                    "untagged_cost_percent",
                ),
            ),
        }
        written = {}
        for name, part in parts.items():
            path = f"{out.rstrip('/')}/{name}"
            if write_csv(part, path):
                written[name] = path
        return written
    finally:
        for kept in (distribution, expensive, sums):
            kept.unpersist()
