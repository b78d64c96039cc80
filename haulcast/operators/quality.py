"""Reports about a table: profile, counts of bad values, output contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, col: str) -> DataFrame:
    """One row: size, spread and sign counts of a numeric column."""
    x = F.col(col)
    return df.agg(
        F.count("*").alias("row_count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"),
        F.count_if(x == 0).alias("zeros"), F.count_if(x < 0).alias("negatives"))


def quality_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: negative, null and infinite or NaN values."""
    wide = []
    for c in cols:
        x = F.col(c).cast("double")
        wide.append(F.struct(
            F.lit(c).alias("column_name"), F.count_if(x < 0).alias("negatives"),
            F.count_if(x.isNull()).alias("nulls"),
            F.count_if(F.isnan(x) | (F.abs(x) == float("inf"))).alias("not_finite")))
    return df.agg(F.array(*wide).alias("report")).select(F.inline("report"))


def id_difference(a: DataFrame, b: DataFrame, id_col: str) -> DataFrame:
    """Distinct ids of ``a`` that ``b`` lacks."""
    return a.select(id_col).distinct().join(b.select(id_col).distinct(), id_col, "left_anti")


def contract_report(output: DataFrame, source: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """One row: does a prediction table have the rows, columns and ids it must have?

    Ids are compared in one shuffle: each id is reduced to the sides it occurs on.
    """
    tagged = (output.select(F.col(id_col).alias("id"), F.lit(1).alias("in_output"), F.lit(0).alias("in_source"))
              .unionByName(source.select(F.col(id_col).alias("id"), F.lit(0).alias("in_output"),
                                         F.lit(1).alias("in_source"))))
    per_id = tagged.groupBy("id").agg(F.sum("in_output").alias("out_rows"), F.sum("in_source").alias("src_rows"))
    return per_id.agg(
        F.sum("out_rows").alias("output_rows"), F.sum("src_rows").alias("source_rows"),
        F.count_if(F.col("out_rows") == 0).alias("missing_ids"),
        F.count_if(F.col("src_rows") == 0).alias("unexpected_ids"),
    ).select(
        "output_rows", "source_rows", "missing_ids", "unexpected_ids",
        F.lit(list(output.columns) == list(columns)).alias("columns_match"),
        (F.col("output_rows") == F.col("source_rows")).alias("row_count_match"),
        ((F.col("missing_ids") == 0) & (F.col("unexpected_ids") == 0)).alias("id_set_match"))


def preview(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in key order."""
    return df.orderBy(*order).limit(n)
