"""Packing: every token once, gapless sequences, little padding, the same ids as the tokenizer."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from haulcast.llm import packing

SF = "/root/testdata/sf0.001"


def check(placed, texts):
    """Return the share of padding after checking all pieces against whole-text tokenization."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for d, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in placed:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for doc, rows in pieces.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            part = np.array(ids[doc][r.start: r.start + r.length], dtype="<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids[doc]), zlib.crc32(part.tobytes()))
            at += r.length
        assert at == len(ids[doc])
    padding = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding / max(1, sum(map(len, ids.values())))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert check(packing.pack(docs).collect(), texts) < 0.02


@pytest.mark.parametrize("round_rows", [40, 50_000])
def test_many_tasks_hand_on_their_rest(spark, round_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(7, "doc_id")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    if round_rows == 40:
        docs, texts = docs.filter("doc_id < 12"), {k: v for k, v in texts.items() if k < 12}
    check(packing.pack(docs, round_rows=2_000 if round_rows == 40 else round_rows).collect(), texts)


def test_edges(spark):
    texts = {1: None, 2: "", 3: " \n ", 4: "a\x1cb \x1f c", 5: "x<|endoftext|>y", 6: "word " * 30_000, 7: "é́  ß" * 9}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 as start", "2 as klass")
    check(packing.pack(docs).collect(), texts)


def test_empty_table_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string")
    assert packing.pack(twice).count() == 4


def test_cut_lengths():
    for n in range(1, 5_000):
        pieces = packing.cut(n)
        assert sum(pieces) == n and max(pieces) <= 2048
        for p in pieces:
            j = 2048 // p
            assert j >= packing.SMALL or j * p >= 2048 * (1 - packing.WASTE)


def test_fast_path_equals_the_tokenizer():
    ids = packing.word_ids(packing.TOKENIZER)
    words = [w for c in map(chr, range(1, 0x400)) for w in (c, f"a{c}b", f"A{c}{c}'{c}s1", f"'{c}")]
    words += ["it's", "''s", "they'll've", "<|startoftext|>", "a<|endoftext|>b", "I\u0307", "x" * 300, "1/2\u00bd"]
    for word in words:
        assert ids.of(word) == ids.encode(word), ascii(word)
        text = f"one {word} Two"
        assert ids.of(text) == ids.encode(text), ascii(word)
