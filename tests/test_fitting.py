"""Statistics, quantiles, keyed joins, folds and encoders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulcast.operators import blend, encode, entity, folds, keyed, metrics, quality, scale
from haulcast.operators.quantiles import quantiles
from haulcast.operators.stats import fit, moments_excluding, most_frequent


def skewed(spark, n=3000):
    """A third of the rows share one key and one value."""
    return spark.range(n).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("key"),
        F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 7919 % 1009).cast("double")).alias("x"),
        (F.col("id") % 5).cast("int").alias("fold"))


@pytest.mark.parametrize("limit", [10, 100, 10_000])
def test_quantiles_exact_at_any_bucket_size(spark, limit):
    df = skewed(spark)
    x = np.array([r["x"] for r in df.collect()])
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.995, 1.0]
    found = quantiles(df, ["x"], probs, max_bucket_rows=limit)[None, "x"]
    assert np.allclose(found, np.quantile(x, probs), rtol=0, atol=1e-9)


@pytest.mark.parametrize("limit", [20, 10_000])
@pytest.mark.parametrize("leave_out", [False, True])
def test_quantiles_by_fold(spark, limit, leave_out):
    df = skewed(spark)
    pdf = df.toPandas()
    found = quantiles(df, ["x"], [0.5, 0.9], by="fold", leave_out=leave_out, max_bucket_rows=limit)
    for f in range(5):
        part = pdf[(pdf.fold != f) if leave_out else (pdf.fold == f)].x
        assert np.allclose(found[f, "x"], np.quantile(part, [0.5, 0.9]))


def test_many_quantiles_of_two_columns_with_nulls(spark):
    df = skewed(spark).select(F.when(F.col("row_id") % 4 != 0, F.col("x")).alias("a"), (F.col("x") * -2).alias("b"))
    pdf = df.toPandas()
    probs = np.linspace(0, 1, 101).tolist()
    found = quantiles(df, ["a", "b"], probs, max_bucket_rows=50)
    for c in "ab":
        assert np.allclose(found[None, c], np.quantile(pdf[c].dropna(), probs))


def test_quantiles_of_nothing_and_of_one_value(rows):
    df = rows([(None, 3.0), (None, 3.0)], "a double, b double")
    found = quantiles(df, ["a", "b"], [0.1, 0.9])
    assert found[None, "a"] == [None, None] and found[None, "b"] == [3.0, 3.0]


def test_moments_outside_each_fold(spark):
    df = skewed(spark).withColumn("x", F.col("x") + 1e9)
    pdf = df.toPandas()
    for (f, _), (n, mean, sd) in moments_excluding(df, "fold", ["x"]).items():
        rest = pdf[pdf.fold != f].x
        assert n == len(rest) and mean == pytest.approx(rest.mean()) and sd == pytest.approx(rest.std(ddof=0), rel=1e-6)


def test_fold_without_rows_elsewhere(rows):
    df = rows([(0, 1.0), (0, 3.0)], "fold int, x double")
    assert moments_excluding(df, "fold", ["x"]) == {(0, "x"): (0, None, None)}


def test_most_frequent(rows):
    df = rows([("b", None), ("a", None), (None, None)], "c string, e string")
    assert most_frequent(df, ["c", "e"]) == {"c": "a", "e": None}


@pytest.mark.parametrize("broadcast_keys", [0, 1_000])
def test_attach_with_hot_null_and_unseen_keys(spark, broadcast_keys, monkeypatch):
    df = skewed(spark)
    monkeypatch.setattr(keyed, "HOT_KEYS", 10)
    monkeypatch.setattr(keyed, "BROADCAST_KEYS", broadcast_keys)
    stats = keyed.keyed(df, "key", {"mean": F.avg("x")}, keep_rows="n")
    extra = df.limit(3).select("row_id", F.lit(None).cast("string").alias("key"), "x", "fold").unionByName(
        df.limit(2).select("row_id", F.lit("new").alias("key"), "x", "fold"))
    out = stats.attach(df.unionByName(extra)).toPandas()
    pdf = df.toPandas()
    means, sizes = pdf.groupby("key").x.mean(), pdf.groupby("key").size()
    known = out[out.key.isin(means.index)]
    assert len(out) == len(pdf) + 5 and len(known) == len(pdf)
    assert np.allclose(known["mean"], known.key.map(means)) and (known.n == known.key.map(sizes)).all()
    assert out[~out.key.isin(means.index)]["mean"].isna().all()


def test_attach_spreads_hot_rows(spark, monkeypatch):
    monkeypatch.setattr(keyed, "HOT_KEYS", 10)
    monkeypatch.setattr(keyed, "BROADCAST_KEYS", 0)
    df = skewed(spark)
    plan = keyed.keyed(df, "key", {"mean": F.avg("x")}).attach(df)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        sizes = plan.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes.sum() == 3000 and sizes.max() < 1000


def test_attach_a_large_lookup_without_shares(spark, rows, monkeypatch):
    monkeypatch.setattr(keyed, "HOT_KEYS", 10)
    monkeypatch.setattr(keyed, "BROADCAST_KEYS", 0)
    names = rows([("hot", 1.5), ("k1", 2.5), ("unused", 3.5)], "name string, v double")
    out = keyed.as_keyed(names, "name").attach(skewed(spark), on="key")
    got = {(r["key"], r["v"]) for r in out.select("key", "v").distinct().collect()}
    assert out.count() == 3000 and {("hot", 1.5), ("k1", 2.5), ("k2", None)} <= got


@pytest.mark.parametrize("short", [0, 1_000])
def test_ranked_is_the_global_order(spark, monkeypatch, short):
    monkeypatch.setattr(keyed, "BROADCAST_KEYS", short)
    df = spark.range(500).select((F.col("id") * 7919 % 503).alias("v"))
    out = keyed.ranked(df, [F.asc("v")]).toPandas().sort_values("v")
    assert out["rank"].tolist() == list(range(500))


def test_folds_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    one, many = (folds.assign_folds(df.repartition(n), "k", 5) for n in (1, 16))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    sizes = one.groupBy("fold").count().toPandas()["count"]
    assert len(sizes) == 5 and sizes.sum() == 1000 and sizes.min() > 140


@pytest.mark.parametrize("balance", [False, True])
def test_group_folds_keep_entities_together(spark, balance):
    df = folds.assign_group_folds(skewed(spark), "key", 5, balance=balance)
    row = folds.straddling_entities(df, "key").first()
    assert row["entities"] == 98 and row["straddling_entities"] == 0 and df.count() == 3000


def test_balanced_folds_around_a_giant(spark):
    df = folds.assign_group_folds(skewed(spark, 9000), "key", 4, balance=True)
    sizes = sorted(df.groupBy("fold").count().toPandas()["count"])
    assert sizes[-1] == 3000 and sizes[0] > 1200


def test_level_of_filled_folds():
    assert folds._level([0, 0, 0], 9) == 3
    assert folds._level([5, 0, 0], 9) == 2
    assert folds._level([4, 3, 0], 9) == 2


def te_by_hand(pdf, k):
    out = {}
    for f in range(k):
        means = pdf[pdf.fold != f].dropna(subset=["y"]).groupby("c").y.mean()
        for r in pdf[pdf.fold == f].itertuples():
            out[r.id] = means.get(r.c, means.mean()) if r.c is not None else means.mean()
    return out


def test_target_encoding_by_hand(rows):
    data = [(i, c, f, y, True) for i, (c, f, y) in enumerate([
        ("a", 0, 1.0), ("a", 1, 3.0), ("a", 2, 8.0), ("b", 0, 10.0), ("b", 1, None), (None, 2, 5.0), ("only", 1, 4.0)])]
    data += [(100, "a", None, None, False), (101, "new", None, None, False)]
    df = rows(data, "id int, c string, fold int, y double, is_train boolean")
    out = {r["id"]: r["c_te"] for r in encode.target_encode_oof(df, ["c"], "y", 3).collect()}
    pdf = df.toPandas()
    for i, v in te_by_hand(pdf[pdf.is_train], 3).items():
        assert out[i] == pytest.approx(v)
    versions = [pdf[pdf.is_train & (pdf.fold != f)].dropna(subset=["y"]).groupby("c").y.mean() for f in range(3)]
    assert out[100] == pytest.approx(np.mean([m["a"] for m in versions]))
    assert out[101] == pytest.approx(np.mean([m.mean() for m in versions]))


def test_one_hot_unseen_and_null_are_zero(rows):
    df = rows([(1, "b", True), (2, "a", True), (3, None, True), (4, "z", False)], "id int, c string, t boolean")
    out, names = encode.one_hot(df, ["c"], F.col("t"))
    assert names == ["c_is_0", "c_is_1"]
    assert [tuple(r[n] for n in names) for r in out.orderBy("id").collect()] == [(0, 1), (1, 0), (0, 0), (0, 0)]


@pytest.mark.parametrize("n", [5, 1_001, 100_001])
def test_one_hot_vector_of_any_width(spark, n):
    df = spark.range(n + 3).select("id", F.when(F.col("id") < n, F.col("id").cast("string"))
                                   .when(F.col("id") == n, "unseen").alias("c"),
                                   F.element_at(F.array(F.lit("p"), F.lit("q")), (F.col("id") % 2 + 1).cast("int")).alias("d"))
    out = encode.one_hot_vector(df, ["c", "d"], where=F.col("id") < n)
    assert out.columns == ["id", "c", "d", "one_hot"]
    order = sorted(str(k) for k in range(n))
    for r in out.filter(F.col("id").isin(0, 1, 4, n, n + 1)).collect():
        want = {n + r.id % 2} | ({order.index(r.c)} if r.c in order else set())
        assert r.one_hot.size == n + 2 and set(r.one_hot.indices.tolist()) == want


def test_one_hot_takes_many_categories(spark):
    out, names = encode.one_hot(spark.range(1_001).select(F.col("id").cast("string").alias("c")), ["c"])
    assert len(names) == 1_001 and len(out.columns) == 1_002


@pytest.mark.parametrize("limit", [1, 1_000])
def test_quantiles_with_nan_and_infinity(spark, limit):
    inf = float("inf")
    data = [(v,) for v in (1.0, 2.0, 3.0, float("nan"), None)] + [(inf,)]
    df = spark.createDataFrame(data, "x double")
    got = quantiles(df, ["x"], [0.0, 1 / 3, 0.5, 1.0], max_bucket_rows=limit)[None, "x"]
    assert got == [1.0, 2.0, 2.5, inf]


def test_label_codes(rows):
    df = rows([(1, "b"), (2, "a"), (3, None), (4, "z")], "id int, c string")
    codes = lambda d: [r["c_code"] for r in d.orderBy("id").collect()]
    assert codes(encode.label_encode(df, ["c"])) == [1, 0, 2, 3]  # null takes part as "nan"
    assert codes(encode.label_encode(df, ["c"], F.col("id") < 3, None, -1)) == [1, 0, -1, -1]


def test_count_and_cross(rows):
    df = rows([(1, "a", "x"), (2, "a", None), (3, None, "y")], "id int, c string, e string")
    assert [r["c_count"] for r in encode.count_encode(df, ["c"]).orderBy("id").collect()] == [2, 2, None]
    assert encode.frequency_encode(df, ["absent"]).columns == df.columns
    assert [r["k"] for r in encode.cross(df, "c", "e", "k").orderBy("id").collect()] == ["a_x", "a_nan", "nan_y"]


def test_scaling_a_constant(rows):
    df = rows([(1, 5.0, 1.0), (2, 5.0, 3.0)], "id int, a double, b double")
    out = [tuple(r)[1:] for r in scale.scale_standard(df, ["a", "b"]).orderBy("id").collect()]
    assert out == [(0.0, -1.0), (0.0, 1.0)]
    assert [r["a"] for r in scale.scale_robust(df, ["a"]).collect()] == [0.0, 0.0]


def test_scaling_at_one_fold(rows):
    df = rows([(0, 0.0), (0, 2.0), (1, 10.0), (1, 14.0)], "fold int, x double")
    own = sorted(r["x"] for r in scale.scale_standard_by_fold(df, ["x"]).collect())
    assert own == [-6.0, -5.0, 9.0, 13.0]
    assert sorted(r["x"] for r in scale.scale_standard_by_fold(df, ["x"], at=0).collect()) == [-6.0, -5.0, -1.0, 1.0]


def test_interactions(rows):
    df = rows([(2.0, 3.0)], "a double, b double")
    out, names = scale.interactions(df, ["a", "b"], squares=True)
    assert names == ["a", "b", "a_x_a", "a_x_b", "b_x_b"]
    assert tuple(out.select(names).first()) == (2, 3, 4, 6, 9)


def test_entity_of_one_row_has_no_spread(rows):
    df = rows([("a", 1.0), ("b", 1.0), ("b", 3.0), (None, 9.0)], "e string, v double")
    out = {r["e"]: (r["entity_mean"], r["entity_std"]) for r in entity.entity_stats(df, "e", "v").collect()}
    assert out == {"a": (1.0, 0.0), "b": (2.0, pytest.approx(2 ** 0.5))}


def test_stack_and_unstack(rows):
    train, score = rows([(1, 2.0)], "id int, y double"), rows([(2,)], "id int")
    back_train, back_score = entity.unstack(entity.stack(train, score))
    assert [tuple(r) for r in back_train.collect()] == [(1, 2.0)]
    assert [tuple(r) for r in back_score.collect()] == [(2, None)]


def test_pairwise_ratio_names(rows):
    out = entity.pairwise_ratios(rows([(6.0, 3.0, 0.0)], "a double, b double, c double"), ["a", "b", "c"])
    assert out.columns[3:] == ["a_div_b", "a_div_c", "b_div_c"] and tuple(out.first())[3:] == (2.0, None, None)


def test_weights_add_up(rows):
    df = rows([(1.0, 1.5, 3.0), (2.0, 2.5, 0.0)], "y double, a double, b double")
    w = df.limit(1).select(*[c.alias(n) for n, c in blend.inverse_rmse_weights(df, "y", ["a", "b"]).items()]).first()
    assert w["a"] + w["b"] == pytest.approx(1) and w["a"] / w["b"] == pytest.approx(2 / 0.5)


def test_prediction_repair_keeps_zero(rows):
    df = rows([(1, 0.0), (2, -1.0), (3, 4.0)], "id int, p double")
    assert [r["p"] for r in blend.negatives_to_positive_mean(df, "p").orderBy("id").collect()] == [0.0, 4.0, 4.0]
    assert [r["p"] for r in blend.negatives_to_zero(df, "p").orderBy("id").collect()] == [0.0, 0.0, 4.0]


def test_metrics_by_hand(rows):
    df = rows([(0, 1.0, 2.0), (0, 3.0, 3.0), (1, 5.0, 1.0)], "fold int, y double, p double")
    m = metrics.score(df, "y", "p").first()
    assert m["mse"] == pytest.approx(17 / 3) and m["mae"] == pytest.approx(5 / 3)
    assert m["r2"] == pytest.approx(1 - 17 / 8)
    s = metrics.fold_summary(df, "y", "p").first()
    assert (s["folds"], s["mae_mean"], s["mae_std"]) == (2, 2.25, 1.75)


def test_contract_report(rows):
    source = rows([("a",), ("b",), ("b",)], "id string")
    good = quality.contract_report(rows([("b", 1.0), ("a", 2.0), ("b", 3.0)], "id string, p double"), source, "id",
                                   ["id", "p"]).first()
    assert good["columns_match"] and good["row_count_match"] and good["id_set_match"]
    bad = quality.contract_report(rows([("c", 1.0)], "id string, q double"), source, "id", ["id", "p"]).first()
    assert (bad["missing_ids"], bad["unexpected_ids"]) == (2, 1)
    assert not (bad["columns_match"] or bad["row_count_match"] or bad["id_set_match"])


def test_fit_on_empty_frame_gives_null(rows):
    df = rows([], "x double")
    one = rows([(1,)], "id int")
    assert one.select(fit(df, {"m": F.avg("x")})["m"].alias("m")).first()["m"] is None


@pytest.mark.parametrize("sort", [False, True])
def test_quantiles_of_many_partitions(spark, sort):
    """Sketches over sorted partitions see different values each; the result stays exact."""
    df = skewed(spark, 6000)
    df = df.repartitionByRange(40, "x") if sort else df.repartition(40)
    x = np.array([r["x"] for r in df.collect()])
    probs = [0.001, 0.3, 0.5, 0.77, 0.999]
    assert np.allclose(quantiles(df, ["x"], probs, max_bucket_rows=25)[None, "x"], np.quantile(x, probs))


def test_long_keys_are_not_broadcast(spark, monkeypatch):
    stats = keyed.keyed(skewed(spark), "key", {"mean": F.avg("x")})
    assert stats.keys == 98 and stats.rows == 3000 and stats.is_small()
    monkeypatch.setattr(keyed, "BROADCAST_KEY_BYTES", stats.key_bytes - 1)
    assert not stats.is_small()


def test_mode_keeps_the_column_type(rows):
    from haulcast.operators import impute

    df = rows([(1, 4), (2, 4), (3, None)], "id int, c int")
    out = impute.impute_mode(df, ["c"])
    assert dict(out.dtypes)["c"] == "int" and [r["c"] for r in out.orderBy("id").collect()] == [4, 4, 4]
