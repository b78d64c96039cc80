"""Secrets that are no run with a digit: whole assigned values and long runs of letters."""

import random
import string

import pytest

from haulcast.llm import secret_scan


def found(text):
    return [(s, c) for s, c, *_ in secret_scan.candidates_in(text)]


@pytest.mark.parametrize("text, value", [
    ('password = "CorrectHorseBattery"', "CorrectHorseBattery"),
    ("password=P@ss!w0rd-1", "P@ss!w0rd-1"),
    ("DB_PASSWORD: 'x'", "x"),
    ('{"pwd": "a.b.c"}', "a.b.c"),
    ('secret => "two words \\" more"', 'two words \\" more'),
    ("token = eyJh.eyJz.sig ok", "eyJh.eyJz.sig"),
    ('Api_Key:"unclosed', "unclosed"),
    ("passwd\n=\néé", "éé"),
    ("x " + "QwErTyUiOpAsDfGhJkLzXc" + " y", "QwErTyUiOpAsDfGhJkLzXc"),
])
def test_values_are_candidates(text, value):
    assert (text.index(value), value) in found(text)


def test_once_and_bounded():
    assert found('token = "abcdef12345"') == [(9, "abcdef12345")]
    assert found("mypassword1 x, tokens: y, token y, password=") == [(0, "mypassword1")]
    assert found("Q" * 21) == [] and found("Q" * 22 + "=") == [(0, "Q" * 22 + "=")]
    assert found("password" + " " * 200_000 + "x") == [] and len(found("token=" * 20_000)) == 1
    assert found("-" * 40 + " " + "_" * 40) == []
    assert found("password = " + '"' + "\\" * 200_001) != []


def test_short_values_are_not_shown(spark):
    rows = spark.createDataFrame([("x",), ("abc",), ("abcdef12345",)], "c string")
    assert [r[0] for r in rows.select(secret_scan.redacted(rows["c"])).collect()] == ["...+1", "a...+2", "abcd...+7"]


def test_scan_scores_them(spark):
    rng = random.Random(5)
    text = lambda n, chars: "".join(rng.choice(chars) for _ in range(n))
    words = ["user", "table", "value", "order", "price", "number", "report", "index"]
    data = [(k, f'set password = "{text(12, string.ascii_letters + "@!.")}" here', "src") for k in range(60)]
    data += [(k, f"see {'_'.join(rng.choices(words, k=5))} and {'_'.join(rng.choices(words, k=2))}_{k} here", "doc")
             for k in range(60, 120)]
    data.append((120, "see " + "ab_" * 50_000 + "cd", "doc"))
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    rows = secret_scan.scan(docs).collect()
    assert {r.doc_id for r in rows if r.doc_id < 60 and r.start == 16 and r.length == 12 and r.secret} == set(range(60))
    assert not any(r.secret for r in rows if r.doc_id >= 60)
