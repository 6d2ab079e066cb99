"""Column expressions on costs: percentages, changes, trend labels, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Wide enough for sums of money with six digits after the point, and 20,000 times that.
_EXACT = "decimal(32,6)"


def percent_of(part: Column, whole: Column) -> Column:
    """100 * part / whole to two digits, exact ties away from 0; NULL where whole is 0.

    Whole hundredths come from an integral division of decimals, so there is no
    quotient that is rounded twice.
    """
    size, base = F.abs(part.cast(_EXACT)), F.abs(whole.cast(_EXACT))
    twice = F.nullif(base * 2, F.lit(0).cast(_EXACT))
    hundredths = F.call_function("div", size * 20000 + base, twice)
    negative = (part < 0) != (whole < 0)
    return F.when(negative, -hundredths).otherwise(hundredths).cast("double") / 100


def share_percent(part: Column, whole: Column) -> Column:
    """As percent_of, but 0 where the whole is not above 0."""
    return F.when(whole > 0, percent_of(part, whole)).otherwise(F.lit(0.0))


def percent_change(current: Column, previous: Column) -> Column:
    """Change against the previous value: NULL for a new cost, 0 without a base."""
    return (
        F.when(previous > 0, percent_of(current - previous, previous))
        .when((previous == 0) & (current > 0), F.lit(None).cast("double"))
        .otherwise(F.lit(0.0))
    )


def cost_trend(current: Column, previous: Column) -> Column:
    """Label of a change; the first rule that holds wins."""
    # The labels of the report.
    return (
        F.when((previous == 0) & (current > 0), "New Resource")
        .when(current > previous, "Increasing")
        .when(current < previous, "Decreasing")
        .otherwise("Stable")
    )


def two_decimals(value: Column) -> Column:
    """A number as text with two digits after the point."""
    return value.cast("decimal(38,2)").cast("string")


def or_not_available(value: Column) -> Column:
    """Any value as text, a missing one as N/A."""
    return F.coalesce(value.cast("string"), F.lit("N/A"))
