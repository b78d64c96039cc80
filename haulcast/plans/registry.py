"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcast.sources.shipments import shipments
from haulcast.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SHIPMENTS_SQL = """
SELECT l_orderkey::varchar || '|' || l_linenumber::varchar || '|' || l_partkey::varchar || '|'
         || l_suppkey::varchar || '|' || l_shipdate::date::varchar AS row_id,
       'H' || o_custkey::varchar AS hospital_id,
       s_name AS supplier_name,
       CASE WHEN l_partkey % 11 <> 0 THEN 1 - l_discount END AS supplier_reliability,
       CASE WHEN l_suppkey % 7 <> 0 THEN p_size::double END AS equipment_height,
       l_quantity AS equipment_width,
       l_tax AS equipment_weight,
       p_retailprice AS equipment_value,
       o_totalprice AS base_transport_fee,
       CASE WHEN l_orderkey % 19 <> 0 THEN p_type END AS equipment_type,
       CASE WHEN l_orderkey % 13 <> 0 THEN o_orderpriority END AS transport_method,
       CASE WHEN c_nationkey <> s_nationkey THEN 'Yes' ELSE 'No' END AS crossborder_shipping,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'Yes' ELSE 'No' END AS urgent_shipping,
       CASE l_returnflag WHEN 'R' THEN 'Yes' WHEN 'A' THEN 'No' END AS installation_service,
       CASE WHEN l_linestatus = 'O' THEN 'Yes' ELSE 'No' END AS fragile_equipment,
       CASE WHEN c_mktsegment = 'FURNITURE' THEN 'Yes' ELSE 'No' END AS rural_hospital,
       c_mktsegment AS hospital_info,
       n_name AS hospital_location,
       CASE WHEN l_orderkey % 17 <> 0 THEN o_orderdate::date END AS order_placed_date,
       l_shipdate::date AS delivery_date,
       CASE WHEN l_partkey % 23 = 0 THEN NULL
            WHEN l_partkey % 9 = 0 THEN -l_extendedprice
            WHEN l_partkey % 9 = 1 THEN 0.0::double
            ELSE l_extendedprice END AS transport_cost,
       l_orderkey % 10 <> 0 AS is_train
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON c_nationkey = n_nationkey
"""


def query(name: str, sql: str | None = None, **ctes: str) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may read ``shipments`` and the named CTEs before it."""

    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            parts = {"shipments": SHIPMENTS_SQL, **ctes}
            start = "WITH RECURSIVE " if "descent" in ctes else "WITH "
            SQL[name] = start + ",\n".join(f"{n} AS ({body})" for n, body in parts.items()) + "\n" + sql
        return fn

    return keep


def ships(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return shipments(spark, sf_dir, columns or None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *cols: str, digits: int = 4) -> DataFrame:
    """Round for comparison across engines, whose sums differ in the last digits."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def r(expression: str, digits: int = 4) -> str:
    """SQL counterpart of ``rounded``; adding zero turns -0.0 into 0.0."""
    return f"(round({expression}, {digits}) + 0.0::double)"


def bucket(key: str, seed: int | str, k: int) -> str:
    """SQL counterpart of ``hash_bucket``."""
    return f"((('0x' || substr(md5('{seed}|' || {key}::varchar), 1, 8))::bigint) % {k})::int"


# SQL expressions shared by several twins
DURATION = "(delivery_date - order_placed_date)::double"
SWAPPED = "abs(delivery_date - order_placed_date)::double"
