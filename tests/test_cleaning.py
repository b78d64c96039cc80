"""Edge rows of target, date and imputation rules."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulcast.functions import values as fv
from haulcast.functions.dates import is_month_end, is_weekend, parse_date, weekday
from haulcast.operators import dates, impute, target

COSTS = [(1, None), (2, 0.0), (3, -1.0), (4, -2.0), (5, 10.0), (6, 20.0)]


def values(df, col, order="id"):
    return [r[col] for r in df.orderBy(order).collect()]


@pytest.mark.parametrize("rule, expected", [
    (target.nonpositive_to_positive_mean, [None, 15.0, 15.0, 15.0, 10.0, 20.0]),
    (target.negative_or_null_to_positive_mean, [15.0, 0.0, 15.0, 15.0, 10.0, 20.0]),
    (target.negative_or_null_to_positive_median, [15.0, 0.0, 15.0, 15.0, 10.0, 20.0]),
    (target.clip_lower, [None, 0.0, 0.0, 0.0, 10.0, 20.0]),
    (target.fill_median, [0.0, 0.0, -1.0, -2.0, 10.0, 20.0]),
])
def test_target_rules(rows, rule, expected):
    assert values(rule(rows(COSTS, "id int, y double"), "y"), "y") == expected


def test_log_target_at_and_below_minus_one(rows):
    df = rows(COSTS, "id int, y double")
    plain = values(target.log_target(df, "y", "l"), "l")
    assert plain[:4] == [None, 0.0, None, None] and plain[4] == pytest.approx(math.log1p(10))
    assert values(target.log_target_guarded(df, "y", "l"), "l")[:4] == [0.0, 0.0, 0.0, 0.0]


def test_quantile_filter_is_strict(rows):
    df = rows([(i, float(i)) for i in range(201)], "id int, y double")
    assert target.below_quantile(df, "y", 0.995).count() == 199


def test_quantile_filter_drops_nulls(rows):
    assert target.below_quantile(rows(COSTS, "id int, y double"), "y", 1.0).count() == 4


def test_outlier_rules(rows):
    df = rows([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 100])], "id int, y double")
    assert df.filter(target.outside_iqr(df, "y")).count() == 1
    assert df.filter(target.outside_zscore(df, "y", 2.0)).count() == 1
    assert max(values(target.clip_to_quantiles(df, "y", 0.0, 0.8), "y")) == 5.0


def test_quantile_normal_round_trip_and_ties(rows):
    data = [(i, float(v)) for i, v in enumerate([0.0] * 300 + list(range(1, 701)))] + [(5000, None)]
    df = rows(data, "id int, y double")
    q = target.QuantileNormal.fit(df, "y", 1000)
    out = df.select("id", "y", q.uniform(F.col("y")).alias("u"), q.forward(F.col("y")).alias("z"))
    out = out.withColumn("back", q.backward(F.col("z"))).orderBy("id").toPandas()
    tied = out[out.y == 0].u.unique()
    assert len(tied) == 1 and tied[0] == pytest.approx((299 / 999) / 2, abs=2e-3)
    known = out[out.y > 0]
    assert np.allclose(known.back, known.y, atol=0.5)
    assert out[out.id == 5000].z.isna().all() and out.z.abs().max() < 5.3


def test_lenient_dates(rows):
    df = rows([(1, "2024-02-29"), (2, "2024-02-30"), (3, "soon"), (4, None)], "id int, t string")
    assert values(df.withColumn("d", parse_date(F.col("t"))), "d") == [dt.date(2024, 2, 29), None, None, None]


def test_pattern_dates(rows):
    df = rows([(1, "29/02/24"), (2, "30/02/24")], "id int, t string")
    assert values(df.withColumn("d", parse_date(F.col("t"), "dd/MM/yy")), "d") == [dt.date(2024, 2, 29), None]


def test_weekday_flags(rows):
    df = rows([(1, dt.date(2024, 1, 1)), (2, dt.date(2024, 1, 6)), (3, None), (4, dt.date(2024, 2, 29))],
              "id int, d date")
    out = df.select("id", weekday(F.col("d")).alias("w"), is_weekend(F.col("d")).alias("e"),
                    is_month_end(F.col("d")).alias("m"))
    assert [tuple(r)[1:] for r in out.orderBy("id").collect()] == [(0, 0, 0), (5, 1, 0), (None, 0, 0), (3, 0, 1)]


def test_swap_leaves_pairs_with_null(rows):
    a, b = dt.date(2024, 1, 1), dt.date(2024, 1, 5)
    df = rows([(1, b, a), (2, a, b), (3, None, a), (4, a, None), (5, a, a)], "id int, o date, d date")
    out = dates.swap_inverted(df, "o", "d").orderBy("id").collect()
    assert [(r.o, r.d) for r in out] == [(a, b), (a, b), (None, a), (a, None), (a, a)]


def test_duration_rounds_down_with_times(rows):
    t = dt.datetime
    df = rows([(1, t(2024, 1, 3), t(2024, 1, 1, 12)), (2, t(2024, 1, 1, 23), t(2024, 1, 2, 1)),
               (3, t(2024, 1, 1, 1), t(2024, 1, 3, 2)), (4, None, t(2024, 1, 1))],
              "id int, o timestamp_ntz, d timestamp_ntz")
    assert values(dates.add_duration(df, "o", "d"), "duration") == [-2.0, 0.0, 2.0, None]


DAYS = [(1, True, 4.0), (2, True, 0.0), (3, True, None), (4, True, -2.0), (5, True, 8.0), (6, True, 9.0),
        (7, False, 100.0), (8, False, 0.0)]


@pytest.mark.parametrize("use, fit_on, bad, expected", [
    ("mean", "train", "nonpositive", [4, 7, 7, 7, 8, 9, 100, 7]),
    ("mean", "frame", "nonpositive", [4, 7, 7, 7, 8, 9, 100, 100]),
    ("mean", "frame", "negative", [4, 0, 7, 7, 8, 9, 100, 0]),
    ("median", "train", "nonpositive", [4, 8, 8, 8, 8, 9, 100, 8]),
    ("median", "frame", "nonpositive", [4, 8, 8, 8, 8, 9, 100, 100]),
    ("median", "all", "null", [4, 0, 4, -2, 8, 9, 100, 0]),
])
def test_duration_rules(rows, use, fit_on, bad, expected):
    df = rows(DAYS, "id int, is_train boolean, duration double")
    assert values(dates.fix_duration(df, "duration", use, fit_on, bad), "duration") == expected


def test_flags(rows):
    df = rows([(1, "Yes"), (2, "No"), (3, "maybe"), (4, None)], "id int, f string")
    assert values(impute.flags_to_int(df, ["f"]), "f") == [1, 0, 0, 0]


def test_mode_tie_takes_smallest_and_train_only(rows):
    df = rows([(1, "b", True), (2, "a", True), (3, None, True), (4, "c", False), (5, "c", False)],
              "id int, c string, t boolean")
    assert values(impute.impute_mode(df, ["c"], F.col("t")), "c") == ["b", "a", "a", "c", "c"]
    assert values(impute.impute_mode(df, ["c"]), "c")[2] == "c"


def test_all_null_column_stays_null(rows):
    df = rows([(1, None), (2, None)], "id int, x double")
    assert values(impute.impute_median(df, ["x"]), "x") == [None, None]
    assert values(impute.impute_mean(df, ["x"]), "x") == [None, None]


def test_infinities_and_ratios(rows):
    df = rows([(1, float("inf")), (2, float("nan")), (3, -float("inf")), (4, 2.0), (5, None)], "id int, x double")
    assert values(impute.drop_infinite(df, ["x"]), "x") == [None, None, None, 2.0, None]
    zero = rows([(1, 1.0, 0.0), (2, 0.0, 0.0), (3, 1.0, 4.0)], "id int, a double, b double")
    assert values(zero.withColumn("q", fv.safe_ratio(F.col("a"), F.col("b"))), "q") == [None, None, 0.25]
