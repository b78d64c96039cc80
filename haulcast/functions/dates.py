"""Date expressions that stay null on bad input instead of failing."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column, pattern: str | None = None) -> Column:
    """Text to date; text that is no date, such as 2024-02-30, becomes null."""
    if pattern is None:
        return text.try_cast("date")
    return F.try_to_timestamp(text, F.lit(pattern)).cast("date")


def swapped(order: Column, delivery: Column) -> tuple[Column, Column]:
    """The pair in calendar order; a pair with a null is left alone."""
    inverted = order > delivery
    return F.when(inverted, delivery).otherwise(order), F.when(inverted, order).otherwise(delivery)


def whole_days_between(start: Column, end: Column) -> Column:
    """Elapsed time in days, rounded down, as a double.

    Calendar days apart, less one when the time of day has not yet been reached.
    On plain dates this is just the calendar difference.
    """
    apart = F.datediff(end, start)
    micros = lambda c: F.unix_micros(c.cast("timestamp")) - F.unix_micros(c.cast("date").cast("timestamp"))
    return (apart - F.when(micros(end) < micros(start), 1).otherwise(0)).cast("double")


def calendar_days_between(start: Column, end: Column) -> Column:
    """Days between two date columns as a double."""
    return F.datediff(end, start).cast("double")


def weekday(day: Column) -> Column:
    """Monday is 0."""
    return F.weekday(day)


def is_weekend(day: Column) -> Column:
    """1 on Saturday and Sunday, 0 otherwise and for null."""
    return F.coalesce((F.weekday(day) >= 5).cast("int"), F.lit(0))


def is_month_end(day: Column) -> Column:
    """1 on the last day of a month, 0 otherwise and for null."""
    return F.coalesce((day.cast("date") == F.last_day(day)).cast("int"), F.lit(0))


def on_circle(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a periodic number such as a month (12) or a weekday (7)."""
    angle = value * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


PARTS = {
    "month": F.month,
    "weekday": weekday,
    "day": F.dayofmonth,
    "quarter": F.quarter,
    "is_weekend": is_weekend,
    "is_month_end": is_month_end,
}
