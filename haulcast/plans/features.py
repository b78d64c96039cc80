"""Aggregates, joins, encoders, scalers and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulcast.operators import dates, encode, entity, folds, scale, target
from haulcast.operators.quantiles import lookup, quantiles
from haulcast.operators.stats import fit, fit_excluding, mean_where
from haulcast.plans.registry import DURATION, bucket, query, r, rounded, ships, table
from haulcast.roles import SHIPMENTS

E = "hospital_id"
Y = "transport_cost"
NUMERIC = list(SHIPMENTS.numeric)
LABELS = ["equipment_type", "transport_method"]
DAYS = f"SELECT row_id, hospital_id, is_train, {DURATION} AS duration FROM shipments"
PER_ENTITY = """
SELECT hospital_id, avg(duration) AS mean, coalesce(stddev_samp(duration), 0) AS std, max(duration) AS max,
       min(duration) AS min, count(*) AS n FROM days GROUP BY hospital_id"""


def _days(spark, d, *more):
    df = ships(spark, d, "row_id", E, "order_placed_date", "delivery_date", *more)
    return dates.add_duration(df, "order_placed_date", "delivery_date").drop("order_placed_date", "delivery_date")


# aggregates ---------------------------------------------------------------------------------------

@query("entity_stats", f"""
SELECT hospital_id, {r('mean')} AS hospital_dur_mean, {r('std')} AS hospital_dur_std, max AS hospital_dur_max,
       min AS hospital_dur_min FROM per_entity""", days=DAYS, per_entity=PER_ENTITY)
def entity_stats(spark, d):
    out = entity.entity_stats(_days(spark, d), E, "duration", prefix="hospital_dur")
    return rounded(out, "hospital_dur_mean", "hospital_dur_std")


@query("entity_stats_short", f"""
SELECT hospital_id, {r('mean')} AS hospital_dur_mean, {r('std')} AS hospital_dur_std FROM per_entity""",
       days=DAYS, per_entity=PER_ENTITY)
def entity_stats_short(spark, d):
    out = entity.entity_stats(_days(spark, d), E, "duration", ["mean", "std"], "hospital_dur")
    return rounded(out, "hospital_dur_mean", "hospital_dur_std")


@query("entity_stats_events", f"""
SELECT user_id, {r('avg(value)')} AS value_mean, {r('coalesce(stddev_samp(value), 0)')} AS value_std,
       max(value) AS value_max, min(value) AS value_min, count(*) AS events FROM events GROUP BY user_id""")
def entity_stats_events(spark, d):
    out = entity.entity_stats(table(spark, d, "events"), "user_id", "value", prefix="value", count="events")
    return rounded(out, "value_mean", "value_std")


@query("entity_count", "SELECT hospital_id, count(*) AS hospital_order_count FROM shipments GROUP BY hospital_id")
def entity_count(spark, d):
    return entity.entity_stats(ships(spark, d, E), E, E, [], count="hospital_order_count")


@query("value_counts", """
SELECT equipment_type, count(*) AS count FROM shipments WHERE equipment_type IS NOT NULL GROUP BY equipment_type""")
def value_counts(spark, d):
    return entity.value_counts(ships(spark, d, "equipment_type"), "equipment_type")


@query("conditional_mean", f"""
SELECT {r('avg(transport_cost) FILTER (transport_cost > 0)')} AS mean_positive,
       {r("avg(transport_cost) FILTER (urgent_shipping = 'Yes')")} AS mean_urgent FROM shipments""")
def conditional_mean(spark, d):
    df = ships(spark, d, Y, "urgent_shipping")
    out = df.agg(mean_where(F.col(Y) > 0, F.col(Y)).alias("mean_positive"),
                 mean_where(F.col("urgent_shipping") == "Yes", F.col(Y)).alias("mean_urgent"))
    return rounded(out, "mean_positive", "mean_urgent")


@query("conditional_median", f"""
SELECT is_train, {r('median(transport_cost)')} AS median_positive FROM shipments
WHERE transport_cost > 0 GROUP BY is_train""")
def conditional_median(spark, d):
    df = ships(spark, d, "is_train", Y).filter(F.col(Y) > 0)
    middle = quantiles(df, [Y], [0.5], by="is_train")
    frames = df.select("is_train").distinct()
    return rounded(frames.withColumn("median_positive", lookup(middle, "is_train", Y)), "median_positive")


@query("global_quantile", f"""
SELECT {r('quantile_cont(transport_cost, 0.995)')} AS q995, {r('quantile_cont(transport_cost, 0.5)')} AS q50
FROM shipments""")
def global_quantile(spark, d):
    q = quantiles(ships(spark, d, Y), [Y], [0.995, 0.5])[None, Y]
    return rounded(spark.createDataFrame([tuple(q)], "q995 double, q50 double"), "q995", "q50")


@query("group_mean_target", f"""
SELECT transport_method, {r('avg(transport_cost)')} AS mean_target FROM shipments
WHERE is_train AND transport_method IS NOT NULL GROUP BY transport_method""")
def group_mean_target(spark, d):
    out = encode.target_encode(ships(spark, d, "transport_method", Y, "is_train"), ["transport_method"], Y)
    return rounded(out.select(F.col("value").alias("transport_method"), "mean_target"), "mean_target")


# joins, unions, ratios ----------------------------------------------------------------------------

@query("join_entity_features", f"""
SELECT row_id, hospital_id, duration, {r('mean')} AS hospital_dur_mean, {r('std')} AS hospital_dur_std,
       max AS hospital_dur_max, min AS hospital_dur_min, n AS hospital_order_count
FROM days JOIN per_entity USING (hospital_id)""", days=DAYS, per_entity=PER_ENTITY)
def join_entity_features(spark, d):
    df = _days(spark, d)
    stats = entity.fit_entity_stats(df, E, "duration", prefix="hospital_dur", count="hospital_order_count")
    return rounded(stats.attach(df), "hospital_dur_mean", "hospital_dur_std")


@query("map_lookup", f"""
SELECT row_id, coalesce(m, {r('(SELECT avg(transport_cost) FROM shipments WHERE is_train)')}) AS method_cost
FROM shipments LEFT JOIN (
  SELECT transport_method, {r('avg(transport_cost)')} AS m FROM shipments WHERE is_train
  AND transport_method IS NOT NULL GROUP BY transport_method) USING (transport_method)""")
def map_lookup(spark, d):
    df = ships(spark, d, "row_id", "transport_method", Y, "is_train")
    train = df.filter("is_train")
    means = rounded(train.filter("transport_method is not null").groupBy("transport_method")
                    .agg(F.avg(Y).alias("m")), "m")
    overall = F.round(fit(train, {"m": F.avg(Y)})["m"], 4)
    return entity.map_values(df, "transport_method", means, "transport_method", "m", "method_cost",
                             overall).select("row_id", "method_cost")


@query("stack_train_score", """
SELECT row_id, equipment_value, CASE WHEN is_train THEN transport_cost END AS transport_cost, is_train
FROM shipments""")
def stack_train_score(spark, d):
    df = ships(spark, d, "row_id", "equipment_value", Y, "is_train")
    train = df.filter("is_train").drop("is_train")
    return entity.stack(train, df.filter("not is_train").drop("is_train", Y))


@query("unstack_train_score", "SELECT row_id, equipment_value FROM shipments WHERE NOT is_train")
def unstack_train_score(spark, d):
    return entity.unstack(ships(spark, d, "row_id", "equipment_value", "is_train"))[1]


@query("attach_columns", """
SELECT row_id, equipment_value, transport_cost FROM shipments""")
def attach_columns(spark, d):
    left, right = ships(spark, d, "row_id", "equipment_value"), ships(spark, d, "row_id", Y)
    return entity.attach_columns(left, right, "row_id", [Y])


WITH_ENTITY = "SELECT * FROM days JOIN per_entity USING (hospital_id)"


def _with_entity(spark, d):
    df = _days(spark, d)
    return entity.fit_entity_stats(df, E, "duration", ["mean", "max"], "hospital_dur").attach(df)


@query("ratio_to_entity_mean", f"""
SELECT row_id, {r('CASE WHEN mean <> 0 THEN duration / mean END')} AS duration_vs_hospital_mean FROM joined""",
       days=DAYS, per_entity=PER_ENTITY, joined=WITH_ENTITY)
def ratio_to_entity_mean(spark, d):
    df = entity.ratio(_with_entity(spark, d), "duration", "hospital_dur_mean", "duration_vs_hospital_mean")
    return rounded(df.select("row_id", "duration_vs_hospital_mean"), "duration_vs_hospital_mean")


@query("diff_to_entity_max", "SELECT row_id, duration - max AS duration_vs_hospital_max FROM joined",
       days=DAYS, per_entity=PER_ENTITY, joined=WITH_ENTITY)
def diff_to_entity_max(spark, d):
    return entity.difference(_with_entity(spark, d), "duration", "hospital_dur_max",
                             "duration_vs_hospital_max").select("row_id", "duration_vs_hospital_max")


FIRST_THREE = ["supplier_reliability", "equipment_width", "equipment_weight"]


@query("pairwise_ratios", "SELECT row_id, " + ", ".join(
    r(f"CASE WHEN {b} <> 0 THEN {a} / {b} END", 7) + f" AS {a}_div_{b}"
    for i, a in enumerate(FIRST_THREE) for b in FIRST_THREE[i + 1:]) + " FROM shipments")
def pairwise_ratios(spark, d):
    df = entity.pairwise_ratios(ships(spark, d, "row_id", *FIRST_THREE), FIRST_THREE).drop(*FIRST_THREE)
    return rounded(df, *df.columns[1:], digits=7)


# encoders -----------------------------------------------------------------------------------------

METHODS = "SELECT *, row_number() OVER (ORDER BY m) - 1 AS i FROM (SELECT DISTINCT transport_method AS m " \
          "FROM shipments WHERE is_train AND transport_method IS NOT NULL)"


@query("encode_one_hot", "SELECT row_id, " + ", ".join(
    f"coalesce((transport_method = (SELECT m FROM methods WHERE i = {i}))::int::double, 0) AS transport_method_is_{i}"
    for i in range(5)) + " FROM shipments", methods=METHODS)
def encode_one_hot(spark, d):
    df = ships(spark, d, "row_id", "transport_method", "is_train")
    return encode.one_hot(df, ["transport_method"], F.col("is_train"))[0].drop("transport_method", "is_train")


@query("encode_label", "SELECT row_id, " + ", ".join(
    f"dense_rank() OVER (ORDER BY coalesce({c}, 'nan')) - 1 AS {c}_code" for c in [E, *LABELS])
       + " FROM shipments")
def encode_label(spark, d):
    names = [E, *LABELS]
    return encode.label_encode(ships(spark, d, "row_id", *names), names).drop(*names)


@query("encode_ordinal_unknown", """
SELECT row_id, coalesce(code, -1)::bigint AS hospital_id_code FROM shipments LEFT JOIN (
  SELECT hospital_id, row_number() OVER (ORDER BY hospital_id) - 1 AS code
  FROM (SELECT DISTINCT hospital_id FROM shipments WHERE is_train)) USING (hospital_id)""")
def encode_ordinal_unknown(spark, d):
    df = ships(spark, d, "row_id", E, "is_train")
    return encode.label_encode(df, [E], F.col("is_train"), None, -1).select("row_id", "hospital_id_code")


@query("encode_count", "SELECT row_id, " + ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN count(*) OVER (PARTITION BY {c}) END AS {c}_count"
    for c in SHIPMENTS.categorical) + " FROM shipments")
def encode_count(spark, d):
    names = SHIPMENTS.categorical
    return encode.count_encode(ships(spark, d, "row_id", *names), names).drop(*names)


@query("encode_frequency_declared", """
SELECT row_id, count(*) OVER (PARTITION BY hospital_location) AS hospital_location_freq FROM shipments""")
def encode_frequency_declared(spark, d):
    df = ships(spark, d, "row_id", "hospital_location")
    return encode.frequency_encode(df, ["customer_id", "hospital_location"]).drop("hospital_location")


CROSSED = """
SELECT row_id, coalesce(equipment_type, 'nan') || '_' || coalesce(transport_method, 'nan') AS type_by_method
FROM shipments"""


@query("encode_cross", """
SELECT row_id, type_by_method, dense_rank() OVER (ORDER BY type_by_method) - 1 AS type_by_method_code
FROM crossed""", crossed=CROSSED)
def encode_cross(spark, d):
    df = encode.cross(ships(spark, d, "row_id", *LABELS), *LABELS, "type_by_method").drop(*LABELS)
    return encode.label_encode(df, ["type_by_method"])


def _te_sql(c: str) -> str:
    """Direct per-fold means: one aggregation for every held-out fold."""
    means = " UNION ALL ".join(
        f"SELECT {f} AS held, {c} AS v, avg(y) AS m FROM folded "
        f"WHERE is_train AND fold <> {f} AND {c} IS NOT NULL GROUP BY {c}" for f in range(5))
    return f"""
SELECT row_id, {r('avg(coalesce(means.m, fb.m))')} AS {c}_te
FROM folded
JOIN (SELECT held, avg(m) AS m FROM ({means}) GROUP BY held) fb ON fb.held = fold OR NOT is_train
LEFT JOIN ({means}) means ON means.held = fb.held AND means.v = {c} GROUP BY row_id"""


FOLDED = f"""SELECT *, {bucket('row_id', 42, 5)} AS fold,
         ln(1 + CASE WHEN transport_cost < 0 THEN 0 ELSE transport_cost END) AS y FROM shipments"""


@query("encode_target_oof",
       f"SELECT * FROM ({_te_sql('transport_method')}) JOIN ({_te_sql('hospital_id')}) USING (row_id)", folded=FOLDED)
def encode_target_oof(spark, d):
    df = folds.assign_folds(ships(spark, d, "row_id", E, "transport_method", Y, "is_train"), "row_id", 5)
    df = target.log_target(target.clip_lower(df, Y), Y, "y")
    out = encode.target_encode_oof(df, ["transport_method", E], "y", 5)
    return rounded(out.select("row_id", "transport_method_te", "hospital_id_te"), "transport_method_te",
                   "hospital_id_te")


# scaling ------------------------------------------------------------------------------------------

WIDTHS = ["equipment_width", "equipment_value"]


@query("scale_standard", "SELECT row_id, " + ", ".join(
    r(f"({c} - (SELECT avg({c}) FROM shipments WHERE is_train)) / "
      f"(SELECT stddev_pop({c}) FROM shipments WHERE is_train)") + f" AS {c}" for c in WIDTHS) + " FROM shipments")
def scale_standard(spark, d):
    df = ships(spark, d, "row_id", *WIDTHS, "is_train")
    return rounded(scale.scale_standard(df, WIDTHS, F.col("is_train")).drop("is_train"), *WIDTHS)


OUTSIDE = " UNION ALL ".join(
    f"SELECT {f} AS fold, " + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in WIDTHS)
    + f" FROM folded WHERE fold <> {f}" for f in range(5))


@query("scale_standard_subset", "SELECT row_id, " + ", ".join(
    r(f"({c} - {c}_m) / {c}_s") + f" AS {c}" for c in WIDTHS) + " FROM folded JOIN outside USING (fold)",
       folded=FOLDED, outside=OUTSIDE)
def scale_standard_subset(spark, d):
    df = folds.assign_folds(ships(spark, d, "row_id", *WIDTHS), "row_id", 5)
    return rounded(scale.scale_standard_by_fold(df, WIDTHS).drop("fold"), *WIDTHS)


@query("scale_robust", "SELECT row_id, " + ", ".join(
    r(f"({c} - (SELECT median({c}) FROM shipments WHERE is_train)) / "
      f"(SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM shipments WHERE is_train)") + f" AS {c}"
    for c in WIDTHS) + " FROM shipments")
def scale_robust(spark, d):
    df = ships(spark, d, "row_id", *WIDTHS, "is_train")
    return rounded(scale.scale_robust(df, WIDTHS, F.col("is_train")).drop("is_train"), *WIDTHS)


THREE = ["equipment_width", "equipment_weight", "equipment_value"]


@query("poly_full_2", f"SELECT row_id, {', '.join(THREE)}, " + ", ".join(
    r(f"{a} * {b}") + f" AS {a}_x_{b}" for i, a in enumerate(THREE) for b in THREE[i:]) + " FROM shipments")
def poly_full_2(spark, d):
    df, names = scale.interactions(ships(spark, d, "row_id", *THREE), THREE, squares=True)
    return rounded(df, *names[3:])


@query("poly_interactions_2", f"SELECT row_id, {', '.join(THREE)}, " + ", ".join(
    r(f"{a} * {b}") + f" AS {a}_x_{b}" for i, a in enumerate(THREE) for b in THREE[i + 1:]) + " FROM shipments")
def poly_interactions_2(spark, d):
    df, names = scale.interactions(ships(spark, d, "row_id", *THREE), THREE)
    return rounded(df, *names[3:])


# splits and folds ---------------------------------------------------------------------------------

@query("split_holdout", f"SELECT row_id, {bucket('row_id', 42, 100)} < 20 AS is_holdout FROM shipments")
def split_holdout(spark, d):
    return folds.assign_holdout(ships(spark, d, "row_id"), "row_id", 20)


@query("folds_shuffled", f"SELECT row_id, {bucket('row_id', 42, 10)} AS fold FROM shipments")
def folds_shuffled(spark, d):
    return folds.assign_folds(ships(spark, d, "row_id"), "row_id", 10)


@query("folds_grouped", f"SELECT row_id, hospital_id, {bucket('hospital_id', 42, 10)} AS fold FROM shipments")
def folds_grouped(spark, d):
    return folds.assign_group_folds(ships(spark, d, "row_id", E), E, 10)


@query("folds_grouped_balanced", """
SELECT row_id, hospital_id, (CASE WHEN s < 5 THEN s ELSE 9 - s END)::int AS fold
FROM shipments JOIN (SELECT hospital_id, (row_number() OVER (ORDER BY count(*) DESC, hospital_id) - 1) % 10 AS s
                     FROM shipments GROUP BY hospital_id) USING (hospital_id)""")
def folds_grouped_balanced(spark, d):
    return folds.assign_group_folds(ships(spark, d, "row_id", E), E, 5, balance=True)


@query("folds_inner", f"""
SELECT row_id, {bucket('row_id', 42, 5)} AS fold, {bucket('row_id', 'inner-42', 3)} AS inner_fold FROM shipments""")
def folds_inner(spark, d):
    df = folds.assign_folds(ships(spark, d, "row_id"), "row_id", 5)
    return folds.assign_folds(df, "row_id", 3, "inner-42", "inner_fold")


@query("fold_leakage_check", """
SELECT count(DISTINCT hospital_id) AS entities, 0::bigint AS straddling_entities FROM shipments""")
def fold_leakage_check(spark, d):
    return folds.straddling_entities(folds.assign_group_folds(ships(spark, d, E), E, 10), E)


@query("fold_fit_statistics", "SELECT fold, " + ", ".join(
    f"{r(f'{c}_m')} AS {c}_mean, {r(f'{c}_s')} AS {c}_sd" for c in WIDTHS) + " FROM outside",
       folded=FOLDED, outside=OUTSIDE)
def fold_fit_statistics(spark, d):
    df = folds.assign_folds(ships(spark, d, "row_id", *WIDTHS), "row_id", 5)
    moment = fit_excluding(df, "fold", WIDTHS)
    out = df.select("fold").distinct().select("fold", *[
        F.round(moment(c, m), 4).alias(f"{c}_{m}") for c in WIDTHS for m in ("mean", "sd")])
    return out


@query("fold_fit_medians", f"SELECT fold, {r('m')} AS base_transport_fee_median FROM outside", folded=FOLDED,
       outside=" UNION ALL ".join(f"SELECT {f}::int AS fold, median(base_transport_fee) AS m FROM folded "
                                  f"WHERE fold <> {f}" for f in range(5)))
def fold_fit_medians(spark, d):
    df = folds.assign_folds(ships(spark, d, "row_id", "base_transport_fee"), "row_id", 5)
    q = quantiles(df, ["base_transport_fee"], [0.5], by="fold", leave_out=True)
    rows = [(f, float(v[0])) for (f, _), v in q.items()]
    return rounded(spark.createDataFrame(rows, "fold int, base_transport_fee_median double"),
                   "base_transport_fee_median")
