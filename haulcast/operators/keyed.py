"""Statistics per entity or category, and joining them back onto rows.

The number of keys grows with the data, so nothing here assumes that a table of
keys is small, and one key may own a large share of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulcast.session import materialise

BROADCAST_KEYS = 500_000
BROADCAST_KEY_BYTES = 64 << 20
HOT_KEYS = 1_000
SALTS = 1_024


@dataclass
class KeyedTable:
    """One row per key, written once.

    ``row_share`` is the column with the rows behind a key. Values are numbers or
    short arrays of them, so the count of keys and the bytes of their text bound
    the size of the table.
    """

    table: DataFrame
    key: str
    keys: int
    row_share: str | None = None
    rows: int | None = None
    key_bytes: int = 0

    @classmethod
    def of(cls, table: DataFrame, key: str, row_share: str | None = None) -> "KeyedTable":
        """Measure a written table: its keys, their bytes, and the rows behind them."""
        rows = F.sum(row_share) if row_share else F.lit(None).cast("long")
        size = table.agg(F.count("*").alias("keys"), text_bytes(key).alias("bytes"), rows.alias("rows")).first()
        return cls(table, key, size["keys"], row_share, size["rows"], size["bytes"] or 0)

    def is_small(self) -> bool:
        return self.keys <= BROADCAST_KEYS and self.key_bytes <= BROADCAST_KEY_BYTES

    def attach(self, df: DataFrame, on: str | None = None) -> DataFrame:
        """Left join onto rows by ``on``; unmatched rows get nulls, columns of the same name are replaced.

        A table counted to be small is broadcast. Beyond that, the keys that own
        more than one row in ``HOT_KEYS`` (at most ``HOT_KEYS`` of them) are
        matched by broadcast, and the rest by a shuffle in which the rows
        already matched, or with a null key, are spread over all tasks.
        """
        on = on or self.key
        values = [c for c in self.table.columns if c not in (self.key, self.row_share)]
        df = df.drop(*[c for c in values if c != on])
        if self.is_small():
            side = self.table.select(F.col(self.key).alias("_k"), *values)
            return df.join(F.broadcast(side), F.col(on) == F.col("_k"), "left").drop("_k")
        if self.row_share is None:
            return self._with_shares(df, on).attach(df, on)

        # the salt of a key that is not hot is a function of the key, on both sides: a constant
        # would be folded away and leave all settled rows with one join key
        salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS))
        packed = self.table.select(F.col(self.key).alias("_k"), F.struct(*values).alias("_v"),
                                   (F.col(self.row_share) * HOT_KEYS > F.lit(self.rows)).alias("_hot"))
        hot = packed.filter("_hot").select(F.col("_k").alias("_hk"), F.col("_v").alias("_hv"))
        cold = packed.filter("not _hot").select(F.col("_k").alias("_ck"), F.col("_v").alias("_cv"),
                                                salt("_k").alias("_cs"))
        rows = df.join(F.broadcast(hot), F.col(on) == F.col("_hk"), "left")
        settled = F.col("_hk").isNotNull() | F.col(on).isNull()
        own = F.col(on).cast(self.table.schema[self.key].dataType)
        rows = (rows.withColumn("_rs", F.when(settled, F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
                                .otherwise(salt(own)))
                .withColumn("_rk", F.when(~settled, own)))
        joined = rows.join(cold, (F.col("_rk") == F.col("_ck")) & (F.col("_rs") == F.col("_cs")), "left")
        picked = F.coalesce("_hv", "_cv")
        return joined.select(*df.columns, *[picked[c].alias(c) for c in values])


    def _with_shares(self, df: DataFrame, on: str) -> "KeyedTable":
        """The same table with the number of rows of ``df`` behind each key."""
        shares = df.filter(F.col(on).isNotNull()).groupBy(F.col(on).alias("_k")).agg(F.count("*").alias("_n"))
        table = self.table.join(shares, F.col(self.key) == F.col("_k"), "left").withColumn(
            "_rows", F.coalesce("_n", F.lit(0))).drop("_k", "_n")
        return KeyedTable.of(materialise(table, "shares"), self.key, "_rows")


def text_bytes(col: str) -> Column:
    """Aggregate: bytes of a column in text form."""
    return F.sum(F.octet_length(F.col(col).cast("string")))


def keyed(df: DataFrame, key: str, aggs: Mapping[str, Column], name: str = "keyed",
          keep_rows: str | None = None) -> KeyedTable:
    """Aggregate per key, pre-aggregated before the shuffle; null keys are left out.

    ``keep_rows`` publishes the row count of a key under that name.
    """
    per_key = df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("_rows"), *[a.alias(n) for n, a in aggs.items()])
    if keep_rows:
        per_key = per_key.withColumn(keep_rows, F.col("_rows"))
    return KeyedTable.of(materialise(per_key, name), key, "_rows")


def as_keyed(table: DataFrame, key: str, name: str = "lookup") -> KeyedTable:
    """A given one-row-per-key table as a ``KeyedTable``."""
    return KeyedTable.of(materialise(table, name), key)


def ranked(df: DataFrame, order: Sequence[Column], name: str = "ranked", rank: str = "rank",
           rows: int | None = None) -> DataFrame:
    """Number the rows 0..n-1 in the given order, in parallel.

    A list counted to be short is numbered in one task. A longer one is range
    partitioned and written with its partition; positions inside a partition are
    then shifted by the sizes of the partitions before it. ``order`` must tell
    all rows apart; ``rows`` saves the count where it is known.
    """
    listed = materialise(df, name) if rows is None else df
    if (listed.count() if rows is None else rows) <= BROADCAST_KEYS:
        return listed.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(listed.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), name)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (placed.withColumn("_inside", inside).join(F.broadcast(before), "_part")
            .withColumn(rank, F.col("_before") + F.col("_inside") - 1)
            .drop("_part", "_inside", "_before"))
