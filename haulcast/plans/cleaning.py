"""Target repair, dates, durations, imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulcast.functions.dates import parse_date
from haulcast.operators import dates, impute, target
from haulcast.plans.registry import DURATION, SWAPPED, query, r, rounded, ships, table
from haulcast.roles import SHIPMENTS

Y = "transport_cost"
NUMERIC = list(SHIPMENTS.numeric)


def _cost(spark, d, *more):
    return ships(spark, d, "row_id", Y, *more)


@query("target_neg_to_positive_mean", f"""
SELECT row_id, {r('CASE WHEN transport_cost <= 0 THEN m ELSE transport_cost END')} AS transport_cost
FROM shipments, (SELECT avg(transport_cost) AS m FROM shipments WHERE transport_cost > 0)""")
def target_neg_to_positive_mean(spark, d):
    return rounded(target.nonpositive_to_positive_mean(_cost(spark, d), Y), Y)


@query("target_neg_null_mean", f"""
SELECT row_id, {r('CASE WHEN transport_cost >= 0 THEN transport_cost ELSE m END')} AS transport_cost
FROM shipments, (SELECT avg(transport_cost) AS m FROM shipments WHERE transport_cost > 0)""")
def target_neg_null_mean(spark, d):
    return rounded(target.negative_or_null_to_positive_mean(_cost(spark, d), Y), Y)


@query("target_neg_null_median", f"""
SELECT row_id, {r('CASE WHEN transport_cost >= 0 THEN transport_cost ELSE m END')} AS transport_cost
FROM shipments, (SELECT median(transport_cost) AS m FROM shipments WHERE transport_cost > 0)""")
def target_neg_null_median(spark, d):
    return rounded(target.negative_or_null_to_positive_median(_cost(spark, d), Y), Y)


@query("target_clip_lower", """
SELECT row_id, CASE WHEN transport_cost < 0 THEN 0.0::double ELSE transport_cost END AS transport_cost
FROM shipments""")
def target_clip_lower(spark, d):
    return target.clip_lower(_cost(spark, d), Y)


@query("target_fill_median", f"""
SELECT row_id, {r('coalesce(transport_cost, (SELECT median(transport_cost) FROM shipments))')} AS transport_cost
FROM shipments""")
def target_fill_median(spark, d):
    return rounded(target.fill_median(_cost(spark, d), Y), Y)


@query("outlier_quantile_filter", """
SELECT row_id, transport_cost FROM shipments
WHERE is_train AND transport_cost < (SELECT quantile_cont(transport_cost, 0.995) FROM shipments WHERE is_train)""")
def outlier_quantile_filter(spark, d):
    train = _cost(spark, d, "is_train").filter("is_train").drop("is_train")
    return target.below_quantile(train, Y, 0.995)


@query("target_log1p", f"""
SELECT row_id, {r('CASE WHEN transport_cost > -1 THEN ln(1 + transport_cost) END')} AS y FROM shipments""")
def target_log1p(spark, d):
    return rounded(target.log_target(_cost(spark, d), Y, "y").select("row_id", "y"), "y")


@query("target_expm1", f"""
SELECT row_id, {r('exp(5 + 100 * equipment_weight) - 1')} AS prediction FROM shipments""")
def target_expm1(spark, d):
    df = ships(spark, d, "row_id", "equipment_weight")
    return rounded(df.select("row_id", F.expm1(5 + 100 * F.col("equipment_weight")).alias("prediction")), "prediction")


@query("target_inf_guard", f"""
SELECT row_id, {r('CASE WHEN transport_cost > -1 THEN ln(1 + transport_cost) ELSE 0 END')} AS y FROM shipments""")
def target_inf_guard(spark, d):
    return rounded(target.log_target_guarded(_cost(spark, d), Y, "y").select("row_id", "y"), "y")


@query("target_quantile_grid", f"""
SELECT (i - 1)::int AS level, {r('qs[i]', 2)} AS value
FROM (SELECT qs, unnest(range(1, 1001)) AS i FROM (
        SELECT quantile_cont(transport_cost, [{', '.join(repr(i / 999) for i in range(1000))}]) AS qs
        FROM shipments))""")
def target_quantile_grid(spark, d):
    fitted = target.QuantileNormal.fit(ships(spark, d, Y), Y)
    rows = [(i, float(v)) for i, v in enumerate(fitted.grid)]
    return rounded(spark.createDataFrame(rows, "level int, value double"), "value", digits=2)


LEVELS = f"""
SELECT v, min(i - 1) / 999.0 AS low, max(i - 1) / 999.0 AS high
FROM (SELECT qs[i] AS v, i FROM (SELECT qs, unnest(range(1, 1001)) AS i FROM (
        SELECT quantile_cont(transport_cost, [{', '.join(repr(i / 999) for i in range(1000))}]) AS qs
        FROM shipments))) GROUP BY v"""


@query("target_quantile_uniform", f"""
SELECT row_id, {r("""CASE WHEN a.v = transport_cost THEN (a.low + a.high) / 2
       ELSE a.high + (transport_cost - a.v) / (b.v - a.v) * (b.low - a.high) END""")} AS u
FROM shipments ASOF LEFT JOIN levels a ON transport_cost >= a.v ASOF LEFT JOIN levels b ON transport_cost <= b.v""",
       levels=LEVELS)
def target_quantile_uniform(spark, d):
    df = _cost(spark, d)
    fitted = target.QuantileNormal.fit(df, Y)
    return rounded(df.select("row_id", fitted.uniform(F.col(Y)).alias("u")), "u")


def _polynomial(x: str, coefficients: tuple[float, ...]) -> str:
    """Powers added one by one, highest first."""
    powers = range(len(coefficients) - 1, -1, -1)
    return "(" + " + ".join(f"{c!r}::double * pow({x}, {k})" for c, k in zip(coefficients, powers)) + ")"


def _quotient(x: str, parts: tuple[tuple[float, ...], tuple[float, ...]]) -> str:
    return f"{_polynomial(x, parts[0])} / {_polynomial(x, parts[1])}"


NORMAL = f"""
SELECT row_id, transport_cost, CASE WHEN abs(p - 0.5) <= 0.425
         THEN (p - 0.5) * {_quotient("(0.180625 - (p - 0.5) * (p - 0.5))", target.CENTRAL)}
         ELSE sign(p - 0.5) * CASE WHEN far <= 5 THEN {_quotient("(far - 1.6)", target.MIDDLE)}
                                   ELSE {_quotient("(far - 5)", target.TAIL)} END END AS z
FROM (SELECT *, sqrt(-ln(least(p, 1 - p))) AS far
      FROM (SELECT *, least(greatest(u, 1e-7), 1 - 1e-7) AS p FROM shares WHERE u IS NOT NULL))
UNION ALL SELECT row_id, transport_cost, NULL FROM shares WHERE u IS NULL"""
# the share of the normal below z by Simpson's rule, which the query finds by a series
BELOW = """
SELECT row_id, (0.5 + z / 1200 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 401),
         lambda k: CASE WHEN k IN (0, 400) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-(z * k / 400) * (z * k / 400) / 2)))
       ) * 999 AS place, z, transport_cost FROM normal"""


@query("target_quantile_normal", f"""
SELECT row_id, transport_cost, {r('z')} AS z, {r('qs[i + 1] + (place - i) * (qs[i + 2] - qs[i + 1])', 2)} AS back
FROM (SELECT *, least(floor(place), 998)::int AS i FROM below),
     (SELECT quantile_cont(transport_cost, [{', '.join(repr(i / 999) for i in range(1000))}]) AS qs FROM shipments)""",
       levels=LEVELS, shares="""
SELECT row_id, transport_cost, CASE WHEN a.v = transport_cost THEN (a.low + a.high) / 2
       ELSE a.high + (transport_cost - a.v) / (b.v - a.v) * (b.low - a.high) END AS u
FROM shipments ASOF LEFT JOIN levels a ON transport_cost >= a.v ASOF LEFT JOIN levels b ON transport_cost <= b.v""",
       normal=NORMAL, below=BELOW)
def target_quantile_normal(spark, d):
    df = _cost(spark, d)
    fitted = target.QuantileNormal.fit(df, Y)
    z = df.withColumn("z", fitted.forward(F.col(Y)))
    return rounded(rounded(z.withColumn("back", fitted.backward(F.col("z"))), "z"), "back", digits=2)


@query("outlier_iqr", """
SELECT row_id, transport_cost, transport_cost < q1 - 1.5 * (q3 - q1) OR transport_cost > q3 + 1.5 * (q3 - q1)
       AS is_outlier
FROM shipments, (SELECT quantile_cont(transport_cost, 0.25) AS q1, quantile_cont(transport_cost, 0.75) AS q3
                 FROM shipments)""")
def outlier_iqr(spark, d):
    df = _cost(spark, d)
    return df.withColumn("is_outlier", target.outside_iqr(df, Y))


@query("outlier_zscore", """
SELECT row_id, transport_cost, abs(transport_cost - m) > 2 * s AS is_outlier
FROM shipments, (SELECT avg(transport_cost) AS m, stddev_pop(transport_cost) AS s FROM shipments)""")
def outlier_zscore(spark, d):
    df = _cost(spark, d)
    return df.withColumn("is_outlier", target.outside_zscore(df, Y, 2.0))


@query("outlier_clip", f"""
SELECT row_id, {r('CASE WHEN transport_cost < a THEN a WHEN transport_cost > b THEN b ELSE transport_cost END', 2)}
       AS transport_cost
FROM shipments, (SELECT quantile_cont(transport_cost, 0.005) AS a, quantile_cont(transport_cost, 0.995) AS b
                 FROM shipments)""")
def outlier_clip(spark, d):
    return rounded(target.clip_to_quantiles(_cost(spark, d), Y), Y, digits=2)


# dates ----------------------------------------------------------------------------------------

@query("date_parse_lenient", """
SELECT event_id, try_cast(raw AS date) AS parsed FROM (
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts::date::varchar WHEN 1 THEN substr(ts::date::varchar, 1, 8) || '31'
                                     WHEN 2 THEN 'unknown' END AS raw FROM events)""")
def date_parse_lenient(spark, d):
    day = F.col("ts").cast("date").cast("string")
    raw = (F.when(F.col("event_id") % 4 == 0, day)
           .when(F.col("event_id") % 4 == 1, F.concat(F.substring(day, 1, 8), F.lit("31")))
           .when(F.col("event_id") % 4 == 2, "unknown"))
    return table(spark, d, "events").select("event_id", parse_date(raw).alias("parsed"))


def _dated(spark, d, *more):
    return ships(spark, d, "row_id", "order_placed_date", "delivery_date", *more)


def _swapped(spark, d, *more):
    df = dates.swap_inverted(_dated(spark, d, *more), "order_placed_date", "delivery_date")
    return dates.add_duration(df, "order_placed_date", "delivery_date")


@query("date_swap_inverted", """
SELECT row_id, CASE WHEN order_placed_date > delivery_date THEN delivery_date ELSE order_placed_date END
                 AS order_placed_date,
       CASE WHEN order_placed_date > delivery_date THEN order_placed_date ELSE delivery_date END AS delivery_date
FROM shipments""")
def date_swap_inverted(spark, d):
    return dates.swap_inverted(_dated(spark, d), "order_placed_date", "delivery_date")


@query("duration_days", f"SELECT row_id, {DURATION} AS duration FROM shipments")
def duration_days(spark, d):
    return dates.add_duration(_dated(spark, d), "order_placed_date", "delivery_date").select("row_id", "duration")


@query("duration_days_with_times", """
SELECT event_id, floor((epoch_us(ts) - epoch_us(started)) / 86400000000.0)::double AS duration
FROM (SELECT event_id, ts, min(ts) OVER (PARTITION BY user_id) + INTERVAL 31 HOUR AS started FROM events)""")
def duration_days_with_times(spark, d):
    events = table(spark, d, "events")
    first = events.groupBy("user_id").agg((F.min("ts") + F.expr("INTERVAL 31 HOURS")).alias("started"))
    df = events.join(first, "user_id")
    return dates.add_duration(df, "started", "ts").select("event_id", "duration")


def _fixed(name: str, use: str, fit_on: str, bad: str, swap: bool, centre: str, wrong: str) -> None:
    """Register one rule of duration repair."""
    value = SWAPPED if swap else DURATION
    sql = f"SELECT row_id, {r(f'CASE WHEN {wrong} THEN c ELSE duration END')} AS duration FROM ({centre})"

    def run(spark, d):
        prepare = _swapped if swap else (
            lambda s, p, *more: dates.add_duration(_dated(s, p, *more), "order_placed_date", "delivery_date"))
        df = dates.fix_duration(prepare(spark, d, "is_train"), "duration", use, fit_on, bad)
        return rounded(df.select("row_id", "duration"), "duration")

    query(name, sql, days=f"SELECT row_id, is_train, {value} AS duration FROM shipments")(run)


PER_FRAME = """SELECT row_id, duration, {agg}(CASE WHEN duration > 0 THEN duration END)
                 OVER (PARTITION BY is_train) AS c FROM days"""
TRAIN = """SELECT row_id, duration, (SELECT {agg}(duration) FROM days WHERE is_train AND duration > 0) AS c FROM days"""
BAD = "duration <= 0 OR duration IS NULL"

_fixed("duration_fix_mean", "mean", "frame", "nonpositive", True, PER_FRAME.format(agg="avg"), BAD)
_fixed("duration_fix_mean_negonly", "mean", "frame", "negative", False, PER_FRAME.format(agg="avg"),
       "duration < 0 OR duration IS NULL")
_fixed("duration_fix_train_mean", "mean", "train", "nonpositive", True, TRAIN.format(agg="avg"), BAD)
_fixed("duration_fix_median", "median", "frame", "nonpositive", True, PER_FRAME.format(agg="median"), BAD)
_fixed("duration_fix_train_median", "median", "train", "nonpositive", True, TRAIN.format(agg="median"), BAD)
_fixed("duration_fill_median_all", "median", "all", "null", False,
       "SELECT row_id, duration, (SELECT median(duration) FROM days) AS c FROM days", "duration IS NULL")


@query("date_month", """
SELECT row_id, month(order_placed_date)::int AS order_month, month(delivery_date)::int AS delivery_month
FROM shipments""")
def date_month(spark, d):
    df = dates.add_date_parts(_dated(spark, d), "order_placed_date", ["month"], "order")
    return dates.add_date_parts(df, "delivery_date", ["month"], "delivery").drop("order_placed_date", "delivery_date")


@query("date_weekday", """
SELECT row_id, (isodow(order_placed_date) - 1)::int AS order_weekday,
       (isodow(delivery_date) - 1)::int AS delivery_weekday FROM shipments""")
def date_weekday(spark, d):
    df = dates.add_date_parts(_dated(spark, d), "order_placed_date", ["weekday"], "order")
    return dates.add_date_parts(df, "delivery_date", ["weekday"], "delivery").drop("order_placed_date", "delivery_date")


@query("date_day_of_month", """
SELECT row_id, day(order_placed_date)::int AS order_day, day(delivery_date)::int AS delivery_day FROM shipments""")
def date_day_of_month(spark, d):
    df = dates.add_date_parts(_dated(spark, d), "order_placed_date", ["day"], "order")
    return dates.add_date_parts(df, "delivery_date", ["day"], "delivery").drop("order_placed_date", "delivery_date")


def _order_part(name: str, part: str, sql: str) -> None:
    def run(spark, d):
        df = ships(spark, d, "row_id", "order_placed_date")
        return dates.add_date_parts(df, "order_placed_date", [part], "order").drop("order_placed_date")

    query(name, f"SELECT row_id, ({sql})::int AS order_{part} FROM shipments")(run)


_order_part("date_quarter", "quarter", "quarter(order_placed_date)")
_order_part("date_is_weekend", "is_weekend", "coalesce(isodow(order_placed_date) >= 6, false)")
_order_part("date_is_month_end", "is_month_end", "coalesce(last_day(order_placed_date) = order_placed_date, false)")


@query("date_cyclical", f"""
SELECT row_id, {r('sin(2 * pi() * m / 12)')} AS order_month_sin, {r('cos(2 * pi() * m / 12)')} AS order_month_cos,
       {r('sin(2 * pi() * w / 7)')} AS order_weekday_sin, {r('cos(2 * pi() * w / 7)')} AS order_weekday_cos
FROM (SELECT row_id, month(order_placed_date) AS m, isodow(order_placed_date) - 1 AS w FROM shipments)""")
def date_cyclical(spark, d):
    df = dates.add_date_parts(ships(spark, d, "row_id", "order_placed_date"), "order_placed_date",
                              ["month", "weekday"], "order")
    df = dates.add_cyclical(dates.add_cyclical(df, "order_month", 12), "order_weekday", 7)
    return rounded(df.drop("order_placed_date", "order_month", "order_weekday"), "order_month_sin",
                   "order_month_cos", "order_weekday_sin", "order_weekday_cos")


# imputation -------------------------------------------------------------------------------------

HOLES = ["supplier_reliability", "equipment_height"]
LABELS = ["equipment_type", "transport_method"]


@query("impute_mean", "SELECT row_id, " + ", ".join(
    r(f"coalesce({c}, (SELECT avg({c}) FROM shipments WHERE is_train))") + f" AS {c}" for c in HOLES)
       + " FROM shipments")
def impute_mean(spark, d):
    df = ships(spark, d, "row_id", *HOLES, "is_train")
    return rounded(impute.impute_mean(df, HOLES, F.col("is_train")).drop("is_train"), *HOLES)


@query("impute_median", "SELECT row_id, " + ", ".join(
    r(f"coalesce({c}, (SELECT median({c}) FROM shipments WHERE is_train))") + f" AS {c}" for c in HOLES)
       + " FROM shipments")
def impute_median(spark, d):
    df = ships(spark, d, "row_id", *HOLES, "is_train")
    return rounded(impute.impute_median(df, HOLES, F.col("is_train")).drop("is_train"), *HOLES)


@query("impute_mode", "SELECT row_id, " + ", ".join(
    f"coalesce({c}, (SELECT {c} FROM shipments WHERE is_train AND {c} IS NOT NULL GROUP BY {c} "
    f"ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}" for c in LABELS) + " FROM shipments")
def impute_mode(spark, d):
    df = ships(spark, d, "row_id", *LABELS, "is_train")
    return impute.impute_mode(df, LABELS, F.col("is_train")).drop("is_train")


@query("impute_constant", "SELECT row_id, " + ", ".join(
    f"coalesce({c}, 'Missing') AS {c}" for c in LABELS) + " FROM shipments")
def impute_constant(spark, d):
    return impute.impute_constant(ships(spark, d, "row_id", *LABELS), LABELS)


@query("impute_zero_all", "SELECT row_id, " + ", ".join(
    f"coalesce({c}, 0) AS {c}" for c in NUMERIC) + " FROM shipments")
def impute_zero_all(spark, d):
    return impute.impute_constant(ships(spark, d, "row_id", *NUMERIC), NUMERIC, 0)


@query("impute_typed", "SELECT row_id, " + ", ".join(
    [f"coalesce({c}, 0) AS {c}" for c in HOLES] + [f"coalesce({c}, 'Missing') AS {c}" for c in LABELS])
       + ", transport_cost FROM shipments")
def impute_typed(spark, d):
    return impute.impute_by_role(ships(spark, d, "row_id", *HOLES, *LABELS, Y), HOLES, LABELS)


@query("impute_median_where_needed", "SELECT row_id, " + ", ".join(
    r(f"coalesce({c}, (SELECT median({c}) FROM shipments))") + f" AS {c}" for c in NUMERIC) + " FROM shipments")
def impute_median_where_needed(spark, d):
    return rounded(impute.impute_median(ships(spark, d, "row_id", *NUMERIC), NUMERIC), *NUMERIC)


@query("inf_to_null", """
SELECT row_id, CASE WHEN equipment_weight <> 0 THEN 1 / equipment_weight END AS per_weight FROM shipments""")
def inf_to_null(spark, d):
    inverse = F.when(F.col("equipment_weight") == 0, float("inf")).otherwise(
        F.try_divide(F.lit(1.0), F.col("equipment_weight")))
    df = ships(spark, d, "row_id", "equipment_weight").select("row_id", inverse.alias("per_weight"))
    return impute.drop_infinite(df, ["per_weight"])


@query("flag_yes_no", "SELECT row_id, " + ", ".join(
    f"(CASE {c} WHEN 'Yes' THEN 1 ELSE 0 END)::int AS {c}" for c in SHIPMENTS.flags) + " FROM shipments")
def flag_yes_no(spark, d):
    return impute.flags_to_int(ships(spark, d, "row_id", *SHIPMENTS.flags), SHIPMENTS.flags)
