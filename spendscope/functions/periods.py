"""Date windows relative to an explicit ``as_of`` day.

The bounds are computed on the driver and reach the scan as date literals, so a
table partitioned by ``date`` is pruned to the days of the window.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendscope.settings import COMPARISON_DAYS, DATE_RANGE_DAYS


def days_before(as_of: date, days: int) -> Column:
    return F.lit(as_of - timedelta(days=days))


def current(as_of: date, days: int, column: str = "date") -> Column:
    """From ``as_of - days`` on, without an upper bound: "7d" covers 8 days
    including ``as_of``, and rows of later days pass."""
    return F.col(column) >= days_before(as_of, days)


def comparison(as_of: date, current_days: int, total_days: int, column: str = "date") -> Column:
    """The days just before the current window: ``total_days - current_days`` of them."""
    return (F.col(column) >= days_before(as_of, total_days)) & (
        F.col(column) < days_before(as_of, current_days)
    )


def range_days(date_range: str) -> int:
    return _lookup(DATE_RANGE_DAYS, date_range, "date_range")


def period_days(comparison_period: str) -> tuple[int, int]:
    return _lookup(COMPARISON_DAYS, comparison_period, "comparison_period")


def week_start(day: Column) -> Column:
    """The Sunday on or before ``day``."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def _lookup(table, key, name):
    if key not in table:
        raise ValueError(f"{name} must be one of {sorted(table)}, got {key!r}")
    return table[key]
