"""Neighbours over numbers and labels, and degree-2 designs, against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from haulcast.operators import encode, scale
from haulcast.operators.knn import knn_predict, mixed_vector
from haulcast.operators.linear import fit_vector_ols


def mixed(spark):
    rng = np.random.default_rng(5)
    label = lambda: [None if x == 0 else f"k{x}" for x in rng.integers(0, 5, 400)]
    pdf = pd.DataFrame({"id": range(400), "x": rng.integers(0, 9, 400) / 4, "a": label(), "b": label(),
                        "y": rng.normal(size=400)})
    # a label that no training row has
    pdf.loc[[0, 4, 8], "a"] = "new"
    rows = [(int(i), float(x), a, b, float(y)) for i, x, a, b, y in pdf.itertuples(index=False)]
    return pdf, spark.createDataFrame(rows, "id int, x double, a string, b string, y double")


@pytest.mark.parametrize("cells, block", [(1, 20_000), (16, 25)])
def test_mixed_neighbours_equal_one_hot_columns(spark, cells, block):
    pdf, df = mixed(spark)
    train = F.expr("id % 4 <> 0")
    df = mixed_vector(df, ["x"], ["a", "b"], train)
    found = knn_predict(df.filter(train), df.filter(~train), "v", "y", "id", 5, cells, block, labels=2)
    found = found.toPandas().set_index("id").prediction
    known = pdf[pdf.id % 4 != 0]
    hot = np.column_stack([pdf.x, *[(pdf[c] == v) for c in "ab" for v in known[c].dropna().unique()]]).astype(float)
    for i in pdf.id[pdf.id % 4 == 0]:
        d = np.round(np.sqrt(((hot[known.id] - hot[i]) ** 2).sum(1)), 9)
        nearest = known.assign(d=d).sort_values(["d", "id"]).head(5)
        assert found[i] == pytest.approx(nearest.y.mean())
    assert len(found) == 100


def test_labels_alone_and_none(spark):
    _, df = mixed(spark)
    only = mixed_vector(df, [], ["a", "b"])
    assert knn_predict(only, only, "v", "y", "id", 1, labels=2).filter("prediction is null").count() == 0
    assert [r.v for r in mixed_vector(df, ["x"], []).filter("id = 1").collect()] == [[r.x] for r in df.filter("id = 1").collect()]


def test_degree_two_terms_equal_the_column_form(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (0.0, -1.0, 4.0)], "a double, b double, c double")
    df = df.withColumn("v", array_to_vector(F.array("a", "b", "c")))
    columns, _ = scale.interactions(scale.poly_vector(df, "v"), ["a", "b", "c"], squares=True)
    order = ["a", "a_x_a", "b", "a_x_b", "b_x_b", "c", "a_x_c", "b_x_c", "c_x_c"]
    for row in columns.withColumn("p", vector_to_array("poly")).collect():
        assert list(row.p) == pytest.approx([row[n] for n in order])


def test_least_squares_on_the_expanded_one_hot_design(spark):
    pdf, df = mixed(spark)
    df = encode.one_hot_vector(df, ["a", "b"], "hot", F.expr("id % 4 <> 0"))
    wide = F.array_append(vector_to_array("hot"), F.col("x"))
    df = scale.poly_vector(df.withColumn("v", array_to_vector(wide)), "v")
    train = df.filter("id % 4 <> 0").orderBy("id")
    model = fit_vector_ols(train.unionByName(train.limit(1).withColumn("y", F.lit(None).cast("double"))), "poly", "y", 1000)
    got = model.transform(train).select("prediction", vector_to_array("poly").alias("p"), "y").toPandas()
    x = np.column_stack([np.ones(len(got)), np.stack(got.p.to_numpy())])
    plain = x @ np.linalg.lstsq(x, got.y, rcond=None)[0]
    assert np.abs(got.prediction - plain).max() < 1e-3
