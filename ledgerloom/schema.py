"""The cost line-item table: column names, types and money handling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names of the cost and usage export.
PERIOD = "bill_billing_period_start_date"
SERVICE = "line_item_product_code"
COST = "line_item_unblended_cost"
LINE_TYPE = "line_item_line_item_type"
USAGE_TYPE = "line_item_usage_type"
INSTANCE_TYPE = "product_instance_type"
RESOURCE = "line_item_resource_id"
USAGE_START = "line_item_usage_start_date"
REGION = "product_region_code"
RESERVATION = "reservation_reservation_a_r_n"
RESERVATION_COST = "reservation_effective_cost"
RESERVATION_UNUSED_UPFRONT = "reservation_unused_amortized_upfront_fee_for_billing_period"
RESERVATION_UNUSED_RECURRING = "reservation_unused_recurring_fee"
TAGS = "resource_tags"
OPERATION = "line_item_operation"
USAGE_AMOUNT = "line_item_usage_amount"
PLAN = "savings_plan_savings_plan_a_r_n"
PLAN_COST = "savings_plan_savings_plan_effective_cost"
PLAN_COMMITMENT = "savings_plan_total_commitment_to_date"
PLAN_USED = "savings_plan_used_commitment"
PLAN_RATE = "savings_plan_savings_plan_rate"
PLAN_UPFRONT = "savings_plan_amortized_upfront_commitment_for_billing_period"
PRODUCT = "product"

MEASURES = (
    COST,
    USAGE_AMOUNT,
    RESERVATION_COST,
    RESERVATION_UNUSED_UPFRONT,
    RESERVATION_UNUSED_RECURRING,
    PLAN_COST,
    PLAN_COMMITMENT,
    PLAN_USED,
    PLAN_RATE,
    PLAN_UPFRONT,
)

# SUM of doubles depends on the order rows arrive in; money is summed as decimal.
MONEY = T.DecimalType(28, 10)

_TEXT = (SERVICE, LINE_TYPE, USAGE_TYPE, INSTANCE_TYPE, RESOURCE, REGION, RESERVATION, OPERATION, PLAN)
_STRING_MAP = T.MapType(T.StringType(), T.StringType())

COST_ITEM_SCHEMA = T.StructType(
    [T.StructField(PERIOD, T.DateType()), T.StructField(USAGE_START, T.TimestampType())]
    + [T.StructField(name, T.StringType()) for name in _TEXT]
    + [T.StructField(name, MONEY) for name in MEASURES]
    + [T.StructField(TAGS, _STRING_MAP), T.StructField(PRODUCT, _STRING_MAP)]
)


def exact_cast(expression: str, kind: str) -> str:
    """SQL for a cast that fails, in any ANSI mode, where a value would turn NULL."""
    cast = f"try_cast({expression} AS {kind})"
    failed = f"raise_error(concat('amount out of range for {kind}: ', {expression}))"
    return f"CASE WHEN {expression} IS NULL OR {cast} IS NOT NULL THEN {cast} ELSE {failed} END"


def normalise_costs(items: DataFrame, money: T.DecimalType = MONEY) -> DataFrame:
    """Give an exported cost table the types the reports expect.

    Measures become decimals and the billing period a date; other columns stay.
    Sums have ten more digits than `money`. An amount that does not fit is an
    error, also where ANSI mode is off.
    """
    kind = money.simpleString()
    casts = {name: F.expr(exact_cast(f"`{name}`", kind)) for name in MEASURES if name in items.columns}
    if PERIOD in items.columns and items.schema[PERIOD].dataType != T.DateType():
        casts[PERIOD] = F.to_date(PERIOD)
    return items.withColumns(casts) if casts else items


def money_as_double(report: DataFrame) -> DataFrame:
    """The last step of a report: decimals out as doubles, all else unchanged."""
    return report.select(
        *[
            F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
            for f in report.schema
        ]
    )


def reads(*columns: str):
    """Mark a report with the columns it reads, so that a source can leave out the rest."""

    def mark(report):
        report.columns = columns
        return report

    return mark
