"""Row filters on the cost table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.schema import LINE_TYPE, PERIOD, RESOURCE, SERVICE

# Line types that are no spending, and marks of shared resources.
CREDIT_TYPES = ("Credit", "Refund")
USAGE_TYPE_NAME = "Usage"
SHARED_RESOURCE_MARKS = ("management", "overhead")


def in_period(items: DataFrame, period: dt.date | Column | Iterable[dt.date] | None) -> DataFrame:
    """Items of one billing period, of several, or of all (None).

    A period may be a column expression, such as `current_period()`.
    """
    if period is None:
        return items
    if isinstance(period, Column):
        return items.where(F.col(PERIOD) == period)
    if isinstance(period, dt.date):
        return items.where(F.col(PERIOD) == F.lit(period))
    return items.where(F.col(PERIOD).isin(list(period)))


def is_net() -> Column:
    """Neither credit nor refund; NULL (so no) for a missing line type."""
    return ~F.col(LINE_TYPE).isin(*CREDIT_TYPES)


def net_of_credits(items: DataFrame) -> DataFrame:
    return items.where(is_net())


def usage_only(items: DataFrame) -> DataFrame:
    return items.where(F.col(LINE_TYPE) == USAGE_TYPE_NAME)


def non_empty(items: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns are neither NULL nor empty text."""
    for column in columns:
        items = items.where(F.col(column) != "")
    return items


def of_service(items: DataFrame, service: str) -> DataFrame:
    return items.where(F.col(SERVICE) == service)


def dates_between(column: str, first: dt.date, last: dt.date) -> Column:
    """From midnight of `first` to midnight of `last`, both included.

    The rest of the last day is outside, as in SQL BETWEEN with two dates.
    """
    return F.col(column).between(F.lit(first), F.lit(last))


def without_marks(items: DataFrame, marks: Iterable[str] = SHARED_RESOURCE_MARKS) -> DataFrame:
    """Drop resources whose id contains one of the marks."""
    for mark in marks:
        items = items.where(~F.col(RESOURCE).contains(mark))
    return items


def current_period() -> Column:
    """The first day of the current month, the default period of scheduled reports."""
    return F.trunc(F.current_date(), "month")
