"""Features from the entity a row belongs to, ratios, and stacking of frames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.functions.values import safe_ratio
from haulcast.operators.keyed import KeyedTable, as_keyed, keyed

AGGREGATES = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min, "sum": F.sum, "count": F.count}


def entity_stats(df: DataFrame, entity: str, value: str, stats: Sequence[str] = ("mean", "std", "max", "min"),
                 prefix: str = "entity", count: str | None = None) -> DataFrame:
    """One row per entity with statistics of ``value``; the spread of a single row is 0."""
    return df.filter(F.col(entity).isNotNull()).groupBy(entity).agg(
        *_stat_columns(value, stats, prefix).values(),
        *([F.count("*").alias(count)] if count else []))


def fit_entity_stats(df: DataFrame, entity: str, value: str, stats: Sequence[str] = ("mean", "std", "max", "min"),
                     prefix: str = "entity", count: str | None = None) -> KeyedTable:
    """``entity_stats`` written once, ready to be attached to rows."""
    return keyed(df, entity, _stat_columns(value, stats, prefix), "entity", keep_rows=count)


def _stat_columns(value: str, stats: Sequence[str], prefix: str) -> dict[str, Column]:
    out = {}
    for s in stats:
        column = AGGREGATES[s](value)
        out[f"{prefix}_{s}"] = (F.coalesce(column, F.lit(0.0)) if s == "std" else column).alias(f"{prefix}_{s}")
    return out


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Occurrences per value, most frequent first, ties by value; nulls are not counted."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col).count()
            .orderBy(F.desc("count"), F.asc(col)))


def map_values(df: DataFrame, col: str, table: DataFrame, key: str, value: str, out: str,
               fallback: Column | None = None) -> DataFrame:
    """Translate ``col`` through a lookup table; unmatched values get ``fallback``."""
    side = as_keyed(table.select(F.col(key), F.col(value).alias(out)), key)
    mapped = side.attach(df, on=col)
    return mapped if fallback is None else mapped.withColumn(out, F.coalesce(F.col(out), fallback))


def stack(train: DataFrame, score: DataFrame, frame: str = "is_train") -> DataFrame:
    """Rows of both frames, tagged; columns missing on one side are null."""
    return (train.withColumn(frame, F.lit(True))
            .unionByName(score.withColumn(frame, F.lit(False)), allowMissingColumns=True))


def unstack(df: DataFrame, frame: str = "is_train") -> tuple[DataFrame, DataFrame]:
    """Train and score rows of a stacked frame, without the tag."""
    return df.filter(F.col(frame)).drop(frame), df.filter(~F.col(frame)).drop(frame)


def attach_columns(df: DataFrame, other: DataFrame, row_id: str, cols: Iterable[str]) -> DataFrame:
    """Columns of another frame put beside this one, matched by row key."""
    return df.join(other.select(row_id, *cols), row_id, "left")


def ratio(df: DataFrame, numerator: str, denominator: str, out: str) -> DataFrame:
    return df.withColumn(out, safe_ratio(F.col(numerator), F.col(denominator)))


def difference(df: DataFrame, left: str, right: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(left) - F.col(right))


def pairwise_ratios(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """a / b for every pair of the given columns, null for a zero denominator."""
    return df.withColumns({f"{a}_div_{b}": safe_ratio(F.col(a), F.col(b)) for a, b in combinations(cols, 2)})
