"""The nested table of out-of-fold predictions."""

import pytest
from pyspark.sql import functions as F

from haulcast.operators import ensemble
from haulcast.operators import linear as lm


class Mean:
    """Predicts the mean target of the rows it was given."""

    fits = 0

    def __init__(self, train):
        Mean.fits += 1
        self.value = train.agg(F.avg("y")).first()[0]

    def predict(self, df, out="prediction"):
        return df.withColumn(out, F.lit(self.value))


def frame(spark):
    df = spark.range(60).select("id", (F.col("id") % 3).cast("int").alias("fold"), (F.col("id") * 1.0).alias("x"))
    return df.withColumn("y", F.when(F.col("id") != 5, F.col("x") * 2 + F.col("id") % 7))


def test_every_row_is_predicted_without_its_fold(spark):
    df = frame(spark)
    train, score = df.filter("id < 48"), df.filter("id >= 48")
    Mean.fits = 0
    bases = {"mean": lambda t, v: Mean(t), "line": lambda t, v: lm.fit_linear(t, ["x"], "y")}
    table = ensemble.oof_table(train, score, 3, bases, "id", "y")
    oof, scored = ensemble.base_columns(table, "id", ["mean", "line"])
    got = {r.id: r for r in oof.collect()}
    ensemble.fold_scores(table).collect()
    assert Mean.fits == 3 and len(got) == 48
    rows = train.toPandas()
    for f in range(3):
        out = rows[rows.fold != f].dropna()
        assert all(got[i]["mean"] == pytest.approx(out.y.mean()) for i in rows.id[rows.fold == f])
    means = [rows[rows.fold != f].y.mean() for f in range(3)]
    assert {round(r["mean"], 9) for r in scored.collect()} == {round(sum(means) / 3, 9)} and scored.count() == 12


def test_fold_scores_equal_plain_sums(spark):
    df = frame(spark)
    table = ensemble.oof_table(df, df.limit(0), 3, {"mean": lambda t, v: Mean(t)}, "id", "y")
    rows = df.toPandas()
    for s in ensemble.fold_scores(table).collect():
        held = rows[rows.fold == s.fold].dropna()
        gap = held.y - rows[rows.fold != s.fold].y.mean()
        assert (s.rows, s.mae, s.rmse) == (len(held), pytest.approx(gap.abs().mean()), pytest.approx((gap ** 2).mean() ** 0.5))
    assert table.filter("not held").count() == 0
