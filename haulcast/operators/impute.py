"""Filling nulls with statistics, constants or rules by role."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.functions.values import finite, yes_no_flag
from haulcast.operators.quantiles import medians
from haulcast.operators.stats import fit, most_frequent


def _rows(df: DataFrame, where: Column | None) -> DataFrame:
    return df if where is None else df.filter(where)


def impute_mean(df: DataFrame, cols: Sequence[str], where: Column | None = None) -> DataFrame:
    """Nulls to the column mean over the rows ``where`` holds (all rows by default)."""
    means = fit(_rows(df, where), {c: F.avg(c) for c in cols})
    return df.withColumns({c: F.coalesce(F.col(c), means[c]) for c in cols})


def impute_median(df: DataFrame, cols: Sequence[str], where: Column | None = None) -> DataFrame:
    """Nulls to the exact column median over the rows ``where`` holds."""
    middle = medians(_rows(df, where), cols)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(middle[c])) for c in cols})


def impute_mode(df: DataFrame, cols: Sequence[str], where: Column | None = None) -> DataFrame:
    """Nulls to the most frequent label, ties to the smallest."""
    best = most_frequent(_rows(df, where), cols)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(best[c]).cast(df.schema[c].dataType)) for c in cols})


def impute_constant(df: DataFrame, cols: Sequence[str], value: str | float = "Missing") -> DataFrame:
    return df.fillna(value, subset=list(cols))


def impute_by_role(df: DataFrame, numeric: Iterable[str], text: Iterable[str]) -> DataFrame:
    """Numbers to 0, labels to Missing; columns in neither list, such as the target, stay."""
    return df.fillna({**{c: 0 for c in numeric}, **{c: "Missing" for c in text}})


def drop_infinite(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """NaN and infinities to null."""
    return df.withColumns({c: finite(F.col(c)) for c in cols})


def flags_to_int(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Yes/No columns to 1/0."""
    return df.withColumns({c: yes_no_flag(F.col(c)) for c in cols})
