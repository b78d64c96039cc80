"""Reading input tables and writing prediction tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from haulcast.functions.dates import parse_date


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A parquet table, or a header CSV table with an explicit schema.

    Values that do not fit the schema become null, and NaN never enters: the
    aggregates downstream skip nulls but would spread a NaN.
    """
    if path.rstrip("/").endswith(".parquet"):
        return nan_to_null(spark.read.parquet(path))
    if schema is None:
        raise ValueError("a CSV table needs an explicit schema")
    reader = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
    return nan_to_null(reader.csv(path))


def read_table_with_dates(spark: SparkSession, path: str, schema: StructType | str,
                          date_columns: Iterable[str]) -> DataFrame:
    """``read_table`` whose text columns ``date_columns`` come out as dates, null where unreadable."""
    df = read_table(spark, path, schema)
    return df.withColumns({c: parse_date(F.col(c)) for c in date_columns})


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN to null in every floating column; tables without one are returned as they are."""
    floating = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    if not floating:
        return df
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating})


def write_predictions(df: DataFrame, path: str, id_col: str, prediction_col: str,
                      names: tuple[str, str] | None = None, fmt: str = "csv") -> None:
    """Write (id, prediction) with a header and no index, in parallel part files."""
    id_name, value_name = names or (id_col, prediction_col)
    out = df.select(F.col(id_col).alias(id_name), F.col(prediction_col).alias(value_name))
    writer = out.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
