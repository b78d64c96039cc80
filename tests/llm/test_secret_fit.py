"""The forest of the secret scan and what it looks at come from all findings and all texts."""

import random
import string
from collections import Counter

from pyspark.sql import functions as F

from haulcast.llm import secret_scan

SF = "/root/testdata/sf0.01"


def test_all_labelled_findings_train(spark):
    """The secrets that come last in the order of their hash have a path of their own: it is learned as well."""
    rng = random.Random(6)
    value = lambda: "".join(rng.choice(string.ascii_letters) for _ in range(15)) + "7"
    plain = spark.createDataFrame([(k, "", 0, value(), "see ", " here", 0) for k in range(10_500)], secret_scan.FINDINGS + ", label int")
    data = spark.createDataFrame([(k, "", 0, value(), "see ", " here", 1) for k in range(10_500)], plain.schema)
    data = data.withColumn("h", F.xxhash64("candidate", "before", "after")).toPandas().sort_values("h")
    data["path"] = ["alpha"] * 5_000 + ["gamma"] * 5_500
    secrets = spark.createDataFrame(data.drop(columns="h"), plain.schema)
    model = secret_scan.fit_secrets(secrets.unionAll(plain), trees=20)
    new = [(k, path, 0, value(), "see ", " here", int(path != "")) for k in range(50) for path in ("alpha", "gamma", "")]
    rows = model.score(spark.createDataFrame(new, plain.schema)).collect()
    assert all((r.score >= 0.5) == (r.label == 1) for r in rows)
    assert model.forest.getMaxBins() ** 2 >= 21_000  # Spark takes a sample of the split values otherwise


def test_split_values_come_from_all_findings(spark):
    """One row of 40,000 has a path: trees find it (none does where Spark samples rows for its split values)."""
    data = [(k, "alpha" if k == 31_234 else "", 0, "abcdefgh7", "see ", " here", int(k == 31_234)) for k in range(40_000)]
    labelled = spark.createDataFrame(data, secret_scan.FINDINGS + ", label int").repartition(8)
    model = secret_scan.fit_secrets(labelled)
    assert any(t.depth > 0 for t in model.forest.trees)


def test_words_of_all_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = Counter()
    for r in docs.collect():
        text = r.text or ""
        mask = list(text)
        for start, candidate, *_ in secret_scan.candidates_in(text):
            mask[start: start + len(candidate)] = " " * len(candidate)
        plain.update(w.lower() for w in secret_scan._WORD.findall("".join(mask)))
    rows = secret_scan.scan_texts(docs, "source").filter("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    assert {r.word: r.n for r in rows.collect()} == dict(plain)
    texts = [" ".join([w] * n) for w, n in plain.items()]
    assert secret_scan.Language.counted(rows) == secret_scan.Language.of(texts)


def test_counts_handed_on_early_add_up(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "WORDS_HELD", 1)
    docs = spark.createDataFrame([(1, "The cat, the token=abc.def and THE a", "s"), (2, None, None), (3, "the cat", "s")],
                                 "doc_id long, text string, source string")
    rows = secret_scan.scan_texts(docs, "source").filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")).collect()
    assert {r.word: r.n for r in rows} == {"the": 4, "cat": 2, "token": 1, "and": 1}


def test_edges_are_exact_and_codes_keep_order(spark):
    rng = random.Random(7)
    data = [([float(k), 1.0 if k == 700 else 0.0, rng.choice([0.5, 0.5, 0.5, 0.25])],) for k in range(1_001)]
    table = spark.createDataFrame(data, "_values array<double>").repartition(7)
    edges = secret_scan.quantile_edges(table, 3)
    assert edges[0] == [1_000 * k / 32 for k in range(33)] and edges[1] == [0.0, 1.0] and edges[2] == [0.25, 0.5]
    coded = sorted((r[0], r[1]) for r in table.select("_values", secret_scan._codes(edges)).collect())
    assert all(a[1][0] <= b[1][0] for a, b in zip(coded, coded[1:]))
    assert len({c[1] for v, c in coded if v[1]} - {c[1] for v, c in coded if not v[1]}) == 1


def test_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, second = ({(r.doc_id, r.start, r.length): r.score for r in secret_scan.scan(docs.repartition(n)).collect()} for n in (1, 5))
    assert first == second
