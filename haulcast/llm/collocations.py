"""Collocations: phrases whose words attract each other, from counts in weighted acyclic automata.

1. Each task numbers the words of its shard and counts the n-grams of up to ``longest``
   words. The sorted n-grams become count transducers, one per language and prefix range.
   A range is an equal slice of the hashes of a phrase's first two words, so the phrases
   of a frequent word lie in many ranges.
2. One group per language and range unites the transducers of all shards and adds their
   weights. Counts below ``least`` go: such phrases are neither candidates nor parts.
3. Each range sends the parts of its candidates to the ranges that hold them, once per
   part. There they form an acceptor that is composed with the counts. With a part
   travels the largest count of a candidate that ends with it, for the covering rule.
4. With the answers each range scores its candidates, drops covered ones, and keeps its
   best ``top``; a ranking over languages takes the best of all ranges.

The number of ranges grows with the bytes of the texts, so that a range stays within a
task's memory. Shards are summed before the shuffle, so copies and frequent phrases move
once per shard.

Edge cases: a null text has no words, a null language is ``und``; texts without pieces
of two words add single words only; an empty table gives an empty result. Columns besides
text and lang are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulcast.llm.transducers import FIELDS, SCHEMA, CountTransducer, columns, of_sorted_words, summed, transducers, union
from haulcast.operators.keyed import KeyedTable
from haulcast.session import materialise

# What ends a piece, and a phrase's least count, longest length, covering share and places per language.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
LEAST, LONGEST, COVER_PERCENT, TOP = 10, 3, 50, 2000

# words counted before a task hands on the transducers of a shard
SHARD_WORDS = 2_500_000
# texts are numbered in slices of about this size
SLICE_BYTES = 1 << 20
# text bytes behind one prefix range
RANGE_BYTES = 128 << 20
OUT_BYTES = 8 << 20

_MARK = b"."
_PIECES = bytes.maketrans(PIECE_ENDS, _MARK * len(PIECE_ENDS))
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A hash per word, with one for "no word" in front."""
    return np.array([0, *map(zlib.crc32, words)], dtype=np.uint64) + np.uint64(1)


def ranges_of(phrases: np.ndarray, hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Prefix range of each phrase: a slice of the hashes of its first two words."""
    value = hashes[phrases[:, 0]] * _MIX
    value = (value ^ (value >> np.uint64(31))) + hashes[phrases[:, 1]]
    value = value * _STEP
    value = (value ^ (value >> np.uint64(30))) * _MIX
    return (((value >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


class Shard:
    """Numbered words of a task's texts, per language; 0 stands between pieces."""

    def __init__(self, longest: int, ranges: int):
        self.longest, self.ranges = longest, ranges
        self.clear()

    def clear(self) -> None:
        self.size = 0
        self.number: dict[str, dict[bytes, int]] = {}
        self.ids: dict[str, list[np.ndarray]] = {}

    def add(self, lang: str, data: bytes) -> None:
        if lang not in self.number:
            self.number[lang] = defaultdict(count().__next__, {})
            self.number[lang][_MARK]
            self.ids[lang] = []
        # lower() changes A-Z only, and split() cuts at U+0020 and U+0009 to U+000D
        data = data.lower().translate(_PIECES).replace(_MARK, b" . ") + b" ."
        number, start = self.number[lang], 0
        while start < len(data):
            stop = data.find(b" ", start + SLICE_BYTES)
            words = data[start: stop if stop >= 0 else len(data)].split()
            self.ids[lang].append(np.fromiter(map(number.__getitem__, words), dtype=np.int32, count=len(words)))
            self.size += len(words)
            start = stop if stop >= 0 else len(data)

    def counted(self) -> Iterator[tuple[str, int, CountTransducer]]:
        """(language, range, transducer) of all n-grams."""
        for lang, parts in self.ids.items():
            number = self.number[lang]
            listed = list(number)[1:]
            order = sorted(range(len(listed)), key=listed.__getitem__)
            words = [listed[k] for k in order]
            rank = np.zeros(len(number), dtype=np.int32)
            rank[np.array(order, dtype=np.int64) + 1] = np.arange(1, len(words) + 1)
            phrases, weights = ngram_counts(rank[np.concatenate(parts)], self.longest, len(words))
            place = ranges_of(phrases, word_hashes(words), self.ranges)
            by_range = np.argsort(place, kind="stable")
            edges = np.searchsorted(place[by_range], np.arange(self.ranges + 1))
            for k in range(self.ranges):
                rows = by_range[edges[k]: edges[k + 1]]
                if len(rows):
                    used, local = np.unique(phrases[rows], return_inverse=True)
                    local = local.reshape(len(rows), -1) + (used[0] > 0)
                    labels = [words[u - 1] for u in used.tolist() if u]
                    yield lang, k, CountTransducer.build(labels, local, weights[rows])


def ngram_counts(ids: np.ndarray, longest: int, labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of 1 to ``longest`` nonzero ids, padded with 0 and sorted, and their counts."""
    phrases, weights = [], []
    for n in range(1, longest + 1):
        if len(ids) < n:
            break
        window = np.lib.stride_tricks.sliding_window_view(ids, n)
        whole = window[(window > 0).all(axis=1)]
        distinct, counts = _distinct(whole, labels)
        phrases.append(np.pad(distinct, ((0, 0), (0, longest - n))))
        weights.append(counts)
    together, counts = np.concatenate(phrases), np.concatenate(weights)
    return summed(together, counts, labels)


def _distinct(rows: np.ndarray, labels: int) -> tuple[np.ndarray, np.ndarray]:
    bits = max(1, labels.bit_length())
    width = rows.shape[1]
    if width * bits > 63:
        return summed(rows, np.ones(len(rows), dtype=np.int64), labels)
    key = rows[:, 0].astype(np.int64)
    for d in range(1, width):
        key = (key << bits) | rows[:, d]
    key, counts = np.unique(key, return_counts=True)
    mask = (1 << bits) - 1
    return np.stack([((key >> (bits * (width - 1 - d))) & mask).astype(rows.dtype) for d in range(width)], axis=1), counts


def shard_transducers(docs: DataFrame, ranges: int, longest: int = LONGEST) -> DataFrame:
    """First step: rows (lang, range, transducer) of every shard."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).filter(
        "text is not null")

    def count_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(longest, ranges)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard.add(lang, text.as_py())
                if shard.size >= SHARD_WORDS:
                    yield from _batches(shard.counted())
                    shard.clear()
        if shard.size:
            yield from _batches(shard.counted())

    return rows.mapInArrow(count_shards, f"lang string, range int, {SCHEMA}")


def _batches(found: Iterator[tuple[str, int, CountTransducer]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in held], pa.string()), pa.array([f[1] for f in held], pa.int32()),
             *columns([f[2] for f in held])], names=["lang", "range", *[name for name, _ in FIELDS]])

    for item in found:
        held.append(item)
        size += 16 * len(item[2].label) + 12 * len(item[2].words)
        if size >= OUT_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def united_transducers(shards: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """Second step: one row (lang, range, words_seen, transducer) per range, without counts below ``least``."""

    def unite(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found, seen = union(transducers(table.combine_chunks()), longest, least)
        return pa.Table.from_arrays(
            [pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int32()),
             pa.array([seen], pa.int64()), *columns([found])],
            names=["lang", "range", "words_seen", *[name for name, _ in FIELDS]])

    return shards.groupBy("lang", "range").applyInArrow(unite, f"lang string, range int, words_seen long, {SCHEMA}")


def _phrases(found: CountTransducer, depth: int) -> list[tuple[tuple[bytes, ...], int]]:
    """All phrases as words, with their weights."""
    phrases, weights = found.paths(depth)
    words = [b"", *found.words]
    return [(tuple(words[k] for k in row if k), n) for row, n in zip(phrases.tolist(), weights.tolist())]


def asked_parts(united: DataFrame, ranges: int, longest: int = LONGEST) -> DataFrame:
    """Third step, questions: rows (lang, to, range, part, cover), one per range and part of its candidates.

    ``cover`` is the largest count of a longer candidate of the range that contains the part.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, found in enumerate(transducers(batch)):
                cover: dict[tuple[bytes, ...], int] = {}
                for phrase, n in _phrases(found, longest):
                    for size in range(1, len(phrase)):
                        for at in range(len(phrase) - size + 1):
                            part = phrase[at: at + size]
                            cover[part] = max(cover.get(part, 0), n)
                if not cover:
                    continue
                parts = list(cover)
                number = {w: i + 1 for i, w in enumerate({w for p in parts for w in p})}
                labels = np.array([[number[w] for w in p[:2]] + [0] * (2 - len(p[:2])) for p in parts], dtype=np.int64)
                to = ranges_of(labels, word_hashes(list(number)), ranges)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[k].as_py()] * len(parts), pa.string()), pa.array(to, pa.int32()),
                     pa.array([batch.column(1)[k].as_py()] * len(parts), pa.int32()),
                     pa.array([b" ".join(p) for p in parts], pa.binary()), pa.array(list(cover.values()), pa.int64())],
                    names=["lang", "to", "range", "part", "cover"])

    return united.mapInArrow(ask, "lang string, to int, range int, part binary, cover long")


def answered_parts(asked: DataFrame, united: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Third step, answers: rows (lang, range, part, n, cover) back to the ranges that asked.

    The range that holds a part also sends itself the largest cover that any range named.
    """

    def answer(questions: pa.Table, counts: pa.Table) -> pa.Table:
        parts, covers = questions.column("part").to_pylist(), questions.column("cover").to_pylist()
        largest: dict[bytes, int] = {}
        for part, n in zip(parts, covers):
            largest[part] = max(largest.get(part, 0), n)
        number: dict[bytes, int] = defaultdict(count(1).__next__)
        labels = np.zeros((len(largest), longest), dtype=np.int64)
        for k, part in enumerate(largest):
            for d, word in enumerate(part.split(b" ")):
                labels[k, d] = number[word]
        acceptor = of_sorted_words(number, labels, np.array(list(largest.values()), dtype=np.int64))
        held = next(iter(transducers(counts.combine_chunks())), None) if counts.num_rows else None
        found: dict[bytes, int] = {}
        if held is not None and largest:
            phrases, weights = held.compose(acceptor, longest)
            found = {b" ".join(acceptor.words[k - 1] for k in row if k): n
                     for row, n in zip(phrases.tolist(), weights.tolist())}
        own = list(largest) if held is not None else []
        here = counts.column("range")[0].as_py() if own else 0
        lang = questions.column("lang")[0].as_py() if parts else None
        return pa.Table.from_arrays(
            [pa.array([lang] * (len(parts) + len(own)), pa.string()),
             pa.array(questions.column("range").to_pylist() + [here] * len(own), pa.int32()),
             pa.array(parts + own, pa.binary()),
             pa.array([found.get(p, 0) for p in parts] + [0] * len(own), pa.int64()),
             pa.array([0] * len(parts) + [largest[p] for p in own], pa.int64())],
            names=["lang", "range", "part", "n", "cover"])

    return asked.groupBy("lang", "to").cogroup(united.groupBy("lang", "range")).applyInArrow(
        answer, "lang string, range int, part binary, n long, cover long")


def scored_candidates(united: DataFrame, answers: DataFrame, longest: int = LONGEST, cover_percent: int = COVER_PERCENT,
                      top: int = TOP) -> DataFrame:
    """Fourth step: the best ``top`` candidates of every language and range, as (lang, phrase, a, l, r, score)."""

    def score(counts: pa.Table, answered: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        cover: dict[bytes, int] = {}
        for part, n, c in zip(*[answered.column(name).to_pylist() for name in ("part", "n", "cover")]):
            known[part] = max(known.get(part, 0), n)
            cover[part] = max(cover.get(part, 0), c)
        rows = []
        for found in transducers(counts.combine_chunks()) if counts.num_rows else ():
            for phrase, a in _phrases(found, longest):
                whole = b" ".join(phrase)
                # cover[whole] is the largest count among the longer candidates that contain it
                if len(phrase) < 2 or 100 * cover.get(whole, 0) >= cover_percent * a:
                    continue
                cuts = []
                for k in range(1, len(phrase)):
                    left, right = known[b" ".join(phrase[:k])], known[b" ".join(phrase[k:])]
                    cuts.append((1_000_000 * a * a // (left * right), k, left, right))
                least, _, left, right = min(cuts)
                rows.append((-least, -a, whole, left, right))
        rows = sorted(rows)[:top]
        lang = counts.column("lang")[0].as_py() if rows else None
        return pa.Table.from_arrays(
            [pa.array([lang] * len(rows), pa.string()), pa.array([r[2].decode() for r in rows], pa.string()),
             pa.array([-r[1] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()),
             pa.array([r[4] for r in rows], pa.int64()), pa.array([-r[0] for r in rows], pa.int64())],
            names=["lang", "phrase", "a", "l", "r", "score"])

    return united.groupBy("lang", "range").cogroup(answers.groupBy("lang", "range")).applyInArrow(
        score, "lang string, phrase string, a long, l long, r long, score long")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, cover_percent: int = COVER_PERCENT,
                 top: int = TOP, ranges: int | None = None) -> DataFrame:
    """The best ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its weakest cut, ``n`` all
    words of the language. A phrase of which at least ``cover_percent`` of 100 occurrences lie in one
    longer candidate is dropped.
    """
    if longest < 2:
        raise ValueError("phrases have two words or more")
    if ranges is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    united = materialise(united_transducers(shard_transducers(docs, ranges, longest), longest, least), "counts")
    answers = answered_parts(asked_parts(united, ranges, longest), united, longest)
    best = scored_candidates(united, answers, longest, cover_percent, top)
    # the lists of all ranges meet in groups first, so that one task of a language does not read them all
    groups = F.pmod(F.xxhash64("phrase"), F.lit(math.isqrt(ranges)))
    for part in (["lang", groups], ["lang"]):
        order = Window.partitionBy(*part).orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
        best = best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    totals = united.groupBy("lang").agg(F.sum("words_seen").alias("n"))
    counted = KeyedTable.of(materialise(totals, "languages"), "lang").attach(best)
    return counted.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
