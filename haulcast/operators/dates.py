"""Date repair, durations and date features."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from haulcast.functions.dates import PARTS, calendar_days_between, on_circle, parse_date, swapped, whole_days_between
from haulcast.operators.quantiles import lookup, quantile, quantiles
from haulcast.operators.stats import fit, fit_by, mean_where


def parse_dates(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Text columns to dates, null where the text is no date."""
    return df.withColumns({c: parse_date(F.col(c)) for c in cols})


def swap_inverted(df: DataFrame, order: str, delivery: str) -> DataFrame:
    """Put each pair of dates in calendar order."""
    first, second = swapped(F.col(order), F.col(delivery))
    return df.withColumns({order: first, delivery: second})


def add_duration(df: DataFrame, order: str, delivery: str, out: str = "duration") -> DataFrame:
    """Whole days from order to delivery, rounded down."""
    plain = all(isinstance(df.schema[c].dataType, DateType) for c in (order, delivery))
    days = calendar_days_between if plain else whole_days_between
    return df.withColumn(out, days(F.col(order), F.col(delivery)))


def fix_duration(df: DataFrame, col: str = "duration", use: str = "mean", fit_on: str = "train",
                 bad: str = "nonpositive", frame: str = "is_train") -> DataFrame:
    """Replace unusable durations by the mean or median of the positive ones.

    ``bad`` tells what is replaced besides nulls: ``nonpositive``, ``negative``
    or ``null`` (nothing else). ``fit_on`` tells which rows are averaged:
    ``train``, ``all``, or ``frame`` for the row's own frame. With
    ``bad='null'`` every duration counts, not only the positive ones.
    """
    x = F.col(col)
    wrong = {"nonpositive": x <= 0, "negative": x < 0, "null": F.lit(False)}[bad] | x.isNull()
    usable = F.lit(True) if bad == "null" else x > 0
    return df.withColumn(col, F.when(wrong, _centre(df, col, use, fit_on, usable, frame)).otherwise(x))


def _centre(df: DataFrame, col: str, use: str, fit_on: str, usable: Column, frame: str) -> Column:
    x = F.col(col)
    rows = df.filter(F.col(frame)) if fit_on == "train" else df
    if use == "mean":
        if fit_on == "frame":
            return fit_by(df, frame, {"v": mean_where(usable, x)})["v"]
        return fit(rows, {"v": mean_where(usable, x)})["v"]
    if fit_on == "frame":
        return lookup(quantiles(df.filter(usable), [col], [0.5], by=frame), frame, col)
    return F.lit(quantile(rows.filter(usable), col, 0.5)).cast("double")


def add_date_parts(df: DataFrame, col: str, parts: Iterable[str], prefix: str) -> DataFrame:
    """Month, weekday (Monday 0), day, quarter, weekend and month-end flags of a date."""
    return df.withColumns({f"{prefix}_{p}": PARTS[p](F.col(col)) for p in parts})


def add_cyclical(df: DataFrame, col: str, period: int) -> DataFrame:
    """Sine and cosine of a periodic column as ``{col}_sin`` and ``{col}_cos``."""
    sine, cosine = on_circle(F.col(col), period)
    return df.withColumns({f"{col}_sin": sine, f"{col}_cos": cosine})
