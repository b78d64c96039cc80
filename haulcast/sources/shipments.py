"""The ``shipments`` view: order lines as equipment deliveries to hospitals.

Each column names the tables it is computed from, and only the tables that the
requested columns need are joined. All joins are to a table's unique key that
every line has, so leaving one out changes no row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcast.sources.tables import read_table


def _yes_no(condition: Column) -> Column:
    return F.when(condition, F.lit("Yes")).otherwise(F.lit("No"))


def _unless(condition: Column, value: Column) -> Column:
    return F.when(~condition, value)


def _definitions() -> dict[str, tuple[set[str], Column]]:
    c = F.col
    line = set()
    day = lambda name: c(name).cast("date")
    row_id = F.concat_ws("|", *[c(k).cast("string") for k in
                                ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                         day("l_shipdate").cast("string"))
    cost = (F.when(c("l_partkey") % 23 == 0, F.lit(None).cast("double"))
            .when(c("l_partkey") % 9 == 0, -c("l_extendedprice"))
            .when(c("l_partkey") % 9 == 1, F.lit(0.0))
            .otherwise(c("l_extendedprice")))
    return {
        "row_id": (line, row_id),
        "hospital_id": ({"orders"}, F.concat(F.lit("H"), c("o_custkey").cast("string"))),
        "supplier_name": ({"supplier"}, c("s_name")),
        "supplier_reliability": (line, _unless(c("l_partkey") % 11 == 0, 1 - c("l_discount"))),
        "equipment_height": ({"part"}, _unless(c("l_suppkey") % 7 == 0, c("p_size").cast("double"))),
        "equipment_width": (line, c("l_quantity")),
        "equipment_weight": (line, c("l_tax")),
        "equipment_value": ({"part"}, c("p_retailprice")),
        "base_transport_fee": ({"orders"}, c("o_totalprice")),
        "equipment_type": ({"part"}, _unless(c("l_orderkey") % 19 == 0, c("p_type"))),
        "transport_method": ({"orders"}, _unless(c("l_orderkey") % 13 == 0, c("o_orderpriority"))),
        "crossborder_shipping": ({"orders", "customer", "supplier"},
                                 _yes_no(c("c_nationkey") != c("s_nationkey"))),
        "urgent_shipping": ({"orders"}, _yes_no(c("o_orderpriority") == "1-URGENT")),
        "installation_service": (line, F.when(c("l_returnflag") == "R", "Yes").when(c("l_returnflag") == "A", "No")),
        "fragile_equipment": (line, _yes_no(c("l_linestatus") == "O")),
        "rural_hospital": ({"orders", "customer"}, _yes_no(c("c_mktsegment") == "FURNITURE")),
        "hospital_info": ({"orders", "customer"}, c("c_mktsegment")),
        "hospital_location": ({"orders", "customer", "nation"}, c("n_name")),
        "order_placed_date": ({"orders"}, _unless(c("l_orderkey") % 17 == 0, day("o_orderdate"))),
        "delivery_date": (line, day("l_shipdate")),
        "transport_cost": (line, cost),
        "is_train": (line, c("l_orderkey") % 10 != 0),
    }


def shipments(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Deliveries with the requested columns, in the order asked for."""
    definitions = _definitions()
    names = list(definitions) if columns is None else list(dict.fromkeys(columns))
    needed = set().union(*(definitions[n][0] for n in names))
    read = lambda table: read_table(spark, f"{sf_dir}/{table}.parquet")
    df = read("lineitem")
    if needed & {"orders", "customer", "nation"}:
        # customers and nations join the orders first: fewer rows than lines, shuffled once
        order = read("orders")
        if needed & {"customer", "nation"}:
            order = order.join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
        if "nation" in needed:
            order = order.join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        df = df.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    for table, line_key, key in (("part", "l_partkey", "p_partkey"), ("supplier", "l_suppkey", "s_suppkey")):
        if table in needed:
            df = df.join(read(table), F.col(line_key) == F.col(key))
    return df.select(*[definitions[n][1].alias(n) for n in names])
