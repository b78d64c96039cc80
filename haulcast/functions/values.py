"""Scalar expressions on numbers and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NaN and both infinities to null."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is null for a zero denominator, also for 0/0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def not_below(x: Column, floor: float) -> Column:
    """Clip from below; null stays null."""
    return F.when(x < floor, F.lit(float(floor))).otherwise(x)


def yes_no_flag(x: Column) -> Column:
    """1 for Yes; 0 for No, any other word and null."""
    return F.when(x == "Yes", 1).otherwise(0)


def labelled(x: Column, null_label: str = "Missing") -> Column:
    """Text form of a label with a word in place of null."""
    return F.coalesce(x.cast("string"), F.lit(null_label))


def log_cost(x: Column) -> Column:
    """log(1 + x); null below or at -1, where the logarithm does not exist."""
    return F.log1p(x)


def unlog_cost(x: Column) -> Column:
    """Inverse of ``log_cost``."""
    return F.expm1(x)


def hash_bucket(key: Column, seed: int | str, buckets: int) -> Column:
    """Bucket 0..buckets-1 that depends on key and seed alone.

    Taken from the leading 32 bits of an MD5, which other SQL engines can repeat.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets).cast("int")
