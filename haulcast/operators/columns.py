"""Projection, renaming, typing and routing of columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructType

from haulcast.roles import Roles


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop columns; names that are absent are ignored."""
    return df.drop(*names)


def split_roles(df: DataFrame, roles: Roles) -> DataFrame:
    """Keys, features and target of a task in role order; other columns go."""
    return df.select([c for c in roles.columns() if c in df.columns])


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def align_schema(df: DataFrame, like: StructType) -> DataFrame:
    """The columns of ``like`` in its order; columns ``df`` lacks are null."""
    return df.select([
        F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
        else F.lit(None).cast(f.dataType).alias(f.name) for f in like.fields])


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns of any numeric width."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def select_by_type(df: DataFrame, kind: str, keep: Iterable[str] = ()) -> DataFrame:
    """Columns in ``keep`` followed by all ``numeric`` or all ``text`` columns."""
    found = {"numeric": numeric_columns, "text": text_columns}[kind](df)
    return df.select(list(dict.fromkeys([*keep, *found])))


def select_declared(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """The declared columns that exist, in declared order."""
    return df.select([c for c in dict.fromkeys(wanted) if c in df.columns])


def missing_declared(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    """The declared columns that ``select_declared`` has to leave out."""
    return [c for c in dict.fromkeys(wanted) if c not in df.columns]


def cast_columns(df: DataFrame, text: Iterable[str] = (), number: Iterable[str] = ()) -> DataFrame:
    """Cast columns to text or double so that two frames agree."""
    casts = {c: F.col(c).cast("string") for c in text}
    casts |= {c: F.col(c).try_cast("double") for c in number}
    return df.withColumns(casts)


def cardinality(df: DataFrame, cols: Iterable[str], approximate: bool = False) -> DataFrame:
    """One row per column with its number of distinct values."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    cols = list(cols)
    wide = df.agg(*[count(c).alias(c) for c in cols])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("distinct_values")) for c in cols])))


def route_by_cardinality(df: DataFrame, cols: Iterable[str], one_hot_max: int = 20,
                         target_below: int = 1000, approximate: bool = False) -> DataFrame:
    """How each categorical column is to be encoded, from its number of distinct values."""
    n = F.col("distinct_values")
    return cardinality(df, cols, approximate).select(
        "column_name", "distinct_values",
        F.when(n < target_below, 1).otherwise(0).alias("target_encoded"),
        F.when(n <= one_hot_max, "one_hot").otherwise("ordinal").alias("encoding"))
