"""Secret scanning: extraction against a plain loop, held-out accuracy, edge rows."""

import random
import string

import pytest

from haulcast.llm import secret_scan

SF = "/root/testdata/sf0.01"
ALLOWED = set(string.ascii_letters + string.digits + "_+/-")


def plain_candidates(text):
    out, at = [], 0
    while at < len(text):
        if text[at] not in ALLOWED:
            at += 1
            continue
        end = at
        while end < len(text) and text[end] in ALLOWED:
            end += 1
        run, stop = text[at:end], end
        if any(c.isdigit() for c in run):
            while stop < len(text) and text[stop] == "=" and stop - end < 2:
                stop += 1
            if stop - at >= 8:
                out.append((at, text[at:stop]))
        at = end
    return out


def test_extraction_equals_a_loop():
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("aB3 4=_-/.é\n\"x") for _ in range(200))
        assert [(s, c) for s, c, *_ in secret_scan.candidates_in(text)] == plain_candidates(text)
    assert len(list(secret_scan.candidates_in("a" * 1_000_000 + "1"))) == 1
    assert list(secret_scan.candidates_in("word " * 100_000)) == []


def test_whole_table_finds_the_planted_kinds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = secret_scan.scan(docs).collect()
    assert sorted((r.doc_id, r.start, r.length) for r in rows) == sorted(
        (d, s, len(c)) for d, t in texts.items() for s, c in plain_candidates(t))
    for r in rows:
        found, before = texts[r.doc_id][r.start: r.start + r.length], texts[r.doc_id][max(0, r.start - 12): r.start]
        assert 0 <= r.score <= 1
        if found.startswith("AKIA") or "password=" in before or "token =" in before:
            assert r.secret
        if found.isdigit():
            assert not r.secret


def test_held_out_findings(spark):
    rng = random.Random(4)
    words = ["user", "table", "value", "order", "price", "number", "report", "index"]

    def finding(k):
        if k % 2:
            text = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randrange(20, 40))) + "7"
            return (k, "src/config", 0, text, f"{rng.choice(words)} {rng.choice(['secret', 'passphrase'])} is ", " ok", 1)
        text = rng.choice(["_".join(rng.choices(words, k=3)) + str(rng.randrange(99)), str(rng.randrange(10**12)) + "00"])
        return (k, "docs/readme", 0, text, f"the {rng.choice(words)} {rng.choice(words)} ", " and", 0)

    schema = secret_scan.FINDINGS + ", label int"
    model = secret_scan.fit_secrets(spark.createDataFrame([finding(k) for k in range(400)], schema), trees=20)
    rows = model.score(spark.createDataFrame([finding(k) for k in range(400, 600)], schema)).collect()
    assert sum((r.score >= 0.5) == (r.label == 1) for r in rows) / len(rows) > 0.95


def test_language():
    language = secret_scan.Language.of(["The quick brown fox", "quick quick table"])
    assert language.coverage("quicktable") == 1 and language.coverage("zzquickzz") == pytest.approx(5 / 9)
    assert language.likelihood("quick") > language.likelihood("zzqzx") and language.likelihood("123") == 0


def test_edges(spark):
    data = [(1, None, None, 1.0), (2, "", "a", 1.0), (None, "token = abcdef12345 and 123456789", None, 1.0),
            (3, "x" * 300_000 + "9", "a", 1.0), (3, "x1y2z3w4", "a", 1.0), (3, "x1y2z3w4", "a", 1.0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, score double")
    assert secret_scan.scan(docs).count() == 5
    assert secret_scan.scan(docs.limit(0)).count() == 0
    only = spark.createDataFrame(data[4:], docs.schema)
    assert {r.score for r in secret_scan.scan(only).collect()} == {0.0}
