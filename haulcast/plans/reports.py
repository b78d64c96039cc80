"""Sources, sinks, table reports, projection and typing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from haulcast.operators import columns as cols
from haulcast.operators import quality
from haulcast.operators.blend import blend
from haulcast.plans.registry import query, r, rounded, ships, table
from haulcast.roles import SHIPMENTS
from haulcast.session import shared_dir
from haulcast.sources import tables

NUMERIC = list(SHIPMENTS.numeric)


def _fresh_path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("scan_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv(spark, d):
    source = table(spark, d, "customer")
    path = _fresh_path(spark, "customer-csv")
    source.write.option("header", True).csv(path)
    return tables.read_table(spark, path, source.schema)


@query("scan_csv_dates", "SELECT o_orderkey, o_totalprice, o_orderdate::date AS o_orderdate FROM orders")
def scan_csv_dates(spark, d):
    path = _fresh_path(spark, "orders-csv")
    (table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date").cast("string"))
     .write.option("header", True).csv(path))
    schema = "o_orderkey long, o_totalprice double, o_orderdate string"
    return tables.read_table_with_dates(spark, path, schema, ["o_orderdate"])


@query("scan_parquet", "SELECT l_orderkey, l_quantity, l_shipdate::date AS l_shipdate FROM lineitem")
def scan_parquet(spark, d):
    df = tables.read_table(spark, f"{d}/lineitem.parquet")
    return df.select("l_orderkey", "l_quantity", F.col("l_shipdate").cast("date").alias("l_shipdate"))


@query("write_predictions", f"""
SELECT hospital_id, {r('0.1 * equipment_value + 0.5 * base_transport_fee')} AS transport_cost
FROM shipments WHERE NOT is_train""")
def write_predictions(spark, d):
    df = ships(spark, d, "hospital_id", "equipment_value", "base_transport_fee", "is_train").filter("not is_train")
    predicted = rounded(blend(df, {"equipment_value": 0.1, "base_transport_fee": 0.5}), "prediction")
    path = _fresh_path(spark, "predictions")
    tables.write_predictions(predicted, path, "hospital_id", "prediction", ("hospital_id", "transport_cost"))
    return tables.read_table(spark, path, "hospital_id string, transport_cost double")


@query("table_profile", f"""
SELECT count(*) AS row_count, {r('avg(transport_cost)')} AS mean, {r('stddev_samp(transport_cost)')} AS std,
       min(transport_cost) AS min, max(transport_cost) AS max,
       count(*) FILTER (transport_cost = 0) AS zeros, count(*) FILTER (transport_cost < 0) AS negatives
FROM shipments""")
def table_profile(spark, d):
    return rounded(quality.profile(ships(spark, d, "transport_cost"), "transport_cost"), "mean", "std")


@query("quality_counts", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, count(*) FILTER ({c} < 0) AS negatives, count(*) FILTER ({c} IS NULL) AS nulls,
       count(*) FILTER (isinf({c}) OR isnan({c})) AS not_finite FROM shipments"""
                                               for c in [*NUMERIC, "transport_cost"]))
def quality_counts(spark, d):
    names = [*NUMERIC, "transport_cost"]
    return quality.quality_counts(ships(spark, d, *names), names)


@query("cardinality_report", """
SELECT 'train' AS frame, count(DISTINCT hospital_id) AS distinct_ids FROM shipments WHERE is_train
UNION ALL SELECT 'score', count(DISTINCT hospital_id) FROM shipments WHERE NOT is_train""")
def cardinality_report(spark, d):
    df = ships(spark, d, "hospital_id", "is_train")
    return (df.groupBy(F.when(F.col("is_train"), "train").otherwise("score").alias("frame"))
            .agg(F.count_distinct("hospital_id").alias("distinct_ids")))


@query("distinct_count", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values FROM shipments"
    for c in SHIPMENTS.categorical))
def distinct_count(spark, d):
    return cols.cardinality(ships(spark, d, *SHIPMENTS.categorical), SHIPMENTS.categorical)


@query("route_by_cardinality", """
SELECT column_name, distinct_values, (distinct_values < 1000)::int AS target_encoded,
       CASE WHEN distinct_values <= 20 THEN 'one_hot' ELSE 'ordinal' END AS encoding FROM sizes""",
       sizes=" UNION ALL ".join(
           f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values FROM shipments"
           for c in ("hospital_id", *SHIPMENTS.categorical)))
def route_by_cardinality(spark, d):
    names = ["hospital_id", *SHIPMENTS.categorical]
    return cols.route_by_cardinality(ships(spark, d, *names), names)


@query("check_output_contract", """
SELECT sum(o)::bigint AS output_rows, sum(s)::bigint AS source_rows,
       count(*) FILTER (o = 0) AS missing_ids, count(*) FILTER (s = 0) AS unexpected_ids,
       true AS columns_match, sum(o) = sum(s) AS row_count_match,
       count(*) FILTER (o = 0 OR s = 0) = 0 AS id_set_match
FROM (SELECT hospital_id, count(*) FILTER (transport_cost IS NOT NULL) AS o, count(*) AS s
      FROM shipments WHERE NOT is_train GROUP BY hospital_id)""")
def check_output_contract(spark, d):
    source = ships(spark, d, "hospital_id", "transport_cost", "is_train").filter("not is_train")
    output = source.filter("transport_cost is not null").select("hospital_id", "transport_cost")
    return quality.contract_report(output, source, "hospital_id", ["hospital_id", "transport_cost"])


@query("id_set_difference", """
SELECT DISTINCT hospital_id FROM shipments
WHERE is_train AND hospital_id NOT IN (SELECT hospital_id FROM shipments WHERE NOT is_train)""")
def id_set_difference(spark, d):
    df = ships(spark, d, "hospital_id", "is_train")
    return quality.id_difference(df.filter("is_train"), df.filter("not is_train"), "hospital_id")


@query("preview_rows", """
SELECT row_id, hospital_id, transport_cost FROM shipments ORDER BY row_id LIMIT 5""")
def preview_rows(spark, d):
    return quality.preview(ships(spark, d, "row_id", "hospital_id", "transport_cost"), ["row_id"])


@query("drop_columns", f"""
SELECT row_id, hospital_id, {', '.join(NUMERIC)}, transport_cost FROM shipments""")
def drop_columns(spark, d):
    df = ships(spark, d, "row_id", "hospital_id", *NUMERIC, "hospital_info", "hospital_location", "transport_cost")
    return cols.drop_columns(df, ["hospital_info", "hospital_location", "not_a_column"])


@query("split_roles", f"SELECT {', '.join(SHIPMENTS.columns())} FROM shipments")
def split_roles(spark, d):
    return cols.split_roles(ships(spark, d), SHIPMENTS)


@query("rename_columns", "SELECT hospital_id AS customer_id, transport_cost AS cost FROM shipments WHERE NOT is_train")
def rename_columns(spark, d):
    df = ships(spark, d, "hospital_id", "transport_cost", "is_train").filter("not is_train").drop("is_train")
    return cols.rename_columns(df, {"hospital_id": "customer_id", "transport_cost": "cost"})


@query("align_schema", """
SELECT row_id, NULL::double AS transport_cost, equipment_value, NULL::varchar AS equipment_type
FROM shipments WHERE NOT is_train""")
def align_schema(spark, d):
    score = ships(spark, d, "equipment_value", "row_id", "is_train").filter("not is_train").drop("is_train")
    like = StructType([StructField("row_id", StringType()), StructField("transport_cost", DoubleType()),
                       StructField("equipment_value", DoubleType()), StructField("equipment_type", StringType())])
    return cols.align_schema(score, like)


@query("select_by_type", f"SELECT row_id, {', '.join(NUMERIC)}, transport_cost FROM shipments")
def select_by_type(spark, d):
    return cols.select_by_type(ships(spark, d), "numeric", keep=["row_id"])


@query("select_declared", "SELECT row_id, supplier_name, equipment_type, base_transport_fee FROM shipments")
def select_declared(spark, d):
    wanted = ["row_id", "supplier_name", "equipment_type", "patient_age", "distance_km", "base_transport_fee"]
    return cols.select_declared(ships(spark, d), wanted)


@query("cast_columns", """
SELECT row_id, month(order_placed_date)::varchar AS order_month, weekday_name AS order_weekday,
       (installation_service = 'Yes')::int::double AS installed
FROM (SELECT *, (isodow(order_placed_date) - 1)::varchar AS weekday_name FROM shipments)""")
def cast_columns(spark, d):
    df = ships(spark, d, "row_id", "order_placed_date", "installation_service").select(
        "row_id", F.month("order_placed_date").alias("order_month"),
        F.weekday("order_placed_date").alias("order_weekday"),
        (F.col("installation_service") == "Yes").cast("int").alias("installed"))
    return cols.cast_columns(df, text=["order_month", "order_weekday"], number=["installed"])
