"""Encoding labels as numbers.

Every encoder first reduces all its columns to one table of (column, value)
pairs, pre-aggregated before the shuffle, so any number of columns costs one
pass over the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.functions.values import labelled
from haulcast.operators import keyed
from haulcast.operators.keyed import KeyedTable, ranked
from haulcast.session import materialise


def _pairs(df: DataFrame, labels: Mapping[str, Column], carry: Sequence[str] = ()) -> DataFrame:
    """Rows (name, value, carried columns), one per labelled column, null values dropped."""
    cells = [F.struct(F.lit(n).alias("name"), c.cast("string").alias("value")) for n, c in labels.items()]
    return df.select(*carry, F.inline(F.array(*cells))).filter(F.col("value").isNotNull())


def _rows(df: DataFrame, where: Column | None) -> DataFrame:
    return df if where is None else df.filter(where)


def _per_column(table: DataFrame, cols: Sequence[str]) -> dict[str, tuple[int, int, int]]:
    """Number of distinct values, of rows behind them, and of bytes in them, per column."""
    found = table.groupBy("name").agg(F.count("*").alias("n"), F.sum("_rows").alias("rows"),
                                      keyed.text_bytes("value").alias("bytes")).collect()
    sizes = {r["name"]: (r["n"], r["rows"], r["bytes"]) for r in found}
    return {c: sizes.get(c, (0, 0, 0)) for c in cols}


def category_lists(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """Sorted categories per column, on the driver."""
    lists: dict[str, list[str]] = {c: [] for c in cols}
    for r in _pairs(df, {c: F.col(c) for c in cols}).distinct().collect():
        lists[r["name"]].append(r["value"])
    return {c: sorted(v) for c, v in lists.items()}


def one_hot_vector(df: DataFrame, cols: Sequence[str], out: str = "one_hot", where: Column | None = None) -> DataFrame:
    """One sparse 0/1 vector over the sorted categories of all ``cols``, for any number of them.

    Positions are label codes, joined to the rows; only the number of labels of a
    column reaches the driver. Null and unseen labels are all zeros.
    """
    codes, parts = [f"_{c}_at" for c in cols], [f"_{c}_hot" for c in cols]
    coded = label_encode(df.withColumns({f"_{c}": F.col(c).cast("string") for c in cols}), [f"_{c}" for c in cols],
                         where, null_label=None, suffix="_at")
    most = coded.agg(*[F.max(a).alias(a) for a in codes]).first()
    sizes = {a: -1 if most[a] is None else most[a] for a in codes}
    # the code after the last label is the category that the encoder leaves out
    coded = coded.withColumns({a: F.coalesce(a, F.lit(sizes[a] + 1)).cast("double") for a in codes})
    attributes = [f"named_{a}" for a in codes]
    for a, named in zip(codes, attributes):
        count = {"ml_attr": {"type": "nominal", "num_vals": sizes[a] + 2, "name": a}}
        coded = coded.withColumn(named, F.col(a).alias(named, metadata=count))
    encoder = OneHotEncoder(inputCols=attributes, outputCols=parts, dropLast=True, handleInvalid="error").fit(coded)
    joined = VectorAssembler(inputCols=parts, outputCol=out).transform(encoder.transform(coded))
    return joined.select(*df.columns, out)


def one_hot(df: DataFrame, cols: Sequence[str], where: Column | None = None) -> tuple[DataFrame, list[str]]:
    """A 0/1 column ``{c}_is_{i}`` per i-th sorted category; null and unseen labels are all zeros.

    Returns the frame and the names of the new columns. Every label becomes a column:
    for designs of many labels take ``one_hot_vector``.
    """
    lists = category_lists(_rows(df, where), cols)
    new = {f"{c}_is_{i}": F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0))
           for c in cols for i, v in enumerate(lists[c])}
    return df.withColumns(new), list(new)


def label_encode(df: DataFrame, cols: Sequence[str], where: Column | None = None,
                 null_label: str | None = "nan", unknown: int | None = None, suffix: str = "_code") -> DataFrame:
    """Position of the label among the sorted labels of the fitted rows.

    Null takes part as ``null_label``; with ``null_label=None`` it stays out.
    Labels not seen in the fit get ``unknown``.
    """
    text = {c: F.col(c).cast("string") if null_label is None else labelled(F.col(c), null_label) for c in cols}
    listed = materialise(_pairs(_rows(df, where), text).groupBy("name", "value")
                         .agg(F.count("*").alias("_rows")), "labels")
    sizes = _per_column(listed, cols)
    for c in cols:
        n, rows, size = sizes[c]
        labels = listed.filter(F.col("name") == c).select("value", "_rows")
        codes = ranked(labels, [F.asc("value")], "label-order", c + suffix, n)
        if n > keyed.BROADCAST_KEYS:
            codes = materialise(codes, "codes")
        side = KeyedTable(codes, "value", n, "_rows", rows, size)
        df = side.attach(df.withColumn("_label", text[c]), on="_label").drop("_label")
        if unknown is not None:
            df = df.withColumn(c + suffix, F.coalesce(F.col(c + suffix), F.lit(unknown).cast("long")))
    return df


def count_encode(df: DataFrame, cols: Sequence[str], suffix: str = "_count") -> DataFrame:
    """Occurrences of each label over all rows of ``df``; null stays null."""
    counts = materialise(_pairs(df, {c: F.col(c) for c in cols}).groupBy("name", "value")
                         .agg(F.count("*").alias("_rows")), "counts")
    sizes = _per_column(counts, cols)
    for c in cols:
        side = counts.filter(F.col("name") == c).select("value", "_rows", F.col("_rows").alias(c + suffix))
        n, rows, size = sizes[c]
        df = KeyedTable(side, "value", n, "_rows", rows, size).attach(df, on=c)
    return df


def frequency_encode(df: DataFrame, declared: Sequence[str], suffix: str = "_freq") -> DataFrame:
    """``count_encode`` on the declared columns that exist."""
    present = [c for c in declared if c in df.columns]
    return count_encode(df, present, suffix) if present else df


def cross(df: DataFrame, a: str, b: str, out: str, null_label: str = "nan") -> DataFrame:
    """Two labels joined by an underscore into one."""
    return df.withColumn(out, F.concat_ws("_", labelled(F.col(a), null_label), labelled(F.col(b), null_label)))


def target_encode_oof(df: DataFrame, cols: Sequence[str], target: str, k: int, fold: str = "fold",
                      is_train: str = "is_train", suffix: str = "_te") -> DataFrame:
    """Mean target of the row's category over the folds the row is not in.

    A category without rows there, and null, get the plain mean of the category
    means of those folds. Score rows get the average over the k versions. Sums
    are taken per category and fold once; each version is the total without one
    fold.
    """
    folds = range(k)
    y = F.col("_y")
    train = df.filter(F.col(is_train)).withColumns({"_y": F.col(target), "_f": F.col(fold)})
    sums = _pairs(train, {c: F.col(c) for c in cols}, ["_y", "_f"]).groupBy("name", "value").agg(
        F.count("*").alias("_rows"), F.sum(y).alias("s"), F.count(y).alias("n"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("_f") == f, y)), F.lit(0.0)) for f in folds]).alias("fs"),
        F.array(*[F.count(F.when(F.col("_f") == f, y)) for f in folds]).alias("fn"))
    means = materialise(sums.select("name", "value", "_rows", F.array(*[
        F.try_divide(F.col("s") - F.col("fs")[f], F.col("n") - F.col("fn")[f]) for f in folds]).alias("means")),
        "category-means")
    summary = {r["name"]: r for r in means.groupBy("name").agg(
        F.count("*").alias("n"), F.sum("_rows").alias("rows"), keyed.text_bytes("value").alias("bytes"),
        F.array(*[F.avg(F.col("means")[f]) for f in folds]).alias("fallback")).collect()}
    for c in cols:
        if c not in summary:
            df = df.withColumn(c + suffix, F.lit(None).cast("double"))
            continue
        side = means.filter(F.col("name") == c).select("value", "_rows", F.col("means").alias("_means"))
        fallback = F.array(*[F.lit(v) for v in summary[c]["fallback"]])
        size = summary[c]
        df = KeyedTable(side, "value", size["n"], "_rows", size["rows"], size["bytes"]).attach(df, on=c)
        version = lambda f: F.coalesce(F.get(F.col("_means"), f), F.get(fallback, f))
        average = sum((version(F.lit(f)) for f in folds), F.lit(0.0)) / k
        df = df.withColumn(c + suffix, F.when(F.col(is_train), version(F.col(fold))).otherwise(average)).drop("_means")
    return df


def target_encode(df: DataFrame, cols: Sequence[str], target: str, is_train: str = "is_train") -> DataFrame:
    """Rows (name, value, mean target) over the train rows, for reports."""
    train = df.filter(F.col(is_train)).withColumn("_y", F.col(target))
    return _pairs(train, {c: F.col(c) for c in cols}, ["_y"]).groupBy("name", "value").agg(
        F.avg("_y").alias("mean_target"))
