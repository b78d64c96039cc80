"""Runs of periodic words within documents, found by a suffix automaton with link-cut access.

The words of a text are numbered and their suffix automaton is built. Its suffix
links form a tree in which the suffixes that end at a word are the path from the
state of that prefix to the root. Each appended word accesses its path in a link-cut
tree, which recolours the path with the word's place. The segments met on the way
carry the place where their strings last ended: if it lies p words back and the
deepest string of the segment has at least p words, the text repeats with the
smallest period p. Squares with the same start and period are one run, whose end
moves on with the words. All segments of a text of n words are O(n log n).

Only words that can be in a run are searched: a run of at least ``least`` words and two
periods repeats windows of half of ``least`` words, and these windows cover all of it.
Stretches of words that no repeated window covers are passed over, which loses no run.

Edge cases: null counts as empty, and an empty text has no words, no runs and an empty
collapsed text. Ids may be null or repeated; each row is searched alone. An empty table
gives an empty result. Columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.llm.text import BETWEEN_WORDS, split_words

LEAST_WORDS = 12
# texts handed to the engine at a time
OUT_BYTES = 8 << 20

Run = tuple[int, int, int]
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def suffix_automaton(words: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links, lengths of the longest string per state, and the state of each prefix; state 0 is the root."""
    link, longest, step, prefixes, last = [0], [0], [{}], [], 0
    for place, word in enumerate(words):
        state = len(link)
        link.append(0)
        longest.append(place + 1)
        step.append({})
        at = last
        while word not in step[at]:
            step[at][word] = state
            if not at:
                break
            at = link[at]
        else:
            to = step[at][word]
            if longest[to] == longest[at] + 1:
                link[state] = to
            else:
                half = len(link)
                link.append(link[to])
                longest.append(longest[at] + 1)
                step.append(step[to].copy())
                link[to] = link[state] = half
                while step[at].get(word) == to:
                    step[at][word] = half
                    if not at:
                        break
                    at = link[at]
        last = state
        prefixes.append(state)
    return link, longest, prefixes


class LinkCutPaths:
    """Paths of a rooted forest in splay trees, shallow nodes to the left; every path has one colour.

    ``parent`` holds 0 for roots. The colour of a path is kept at the root of its splay tree.
    """

    def __init__(self, parent: Sequence[int]):
        self.up, self.colour = list(parent), [-1] * len(parent)
        self.left, self.right = [0] * len(parent), [0] * len(parent)

    def splay(self, x: int) -> None:
        """Make x the root of its splay tree; the colour moves with the root."""
        up, left, right, rotate = self.up, self.left, self.right, self._rotate
        y = top = up[x]
        while y and (left[y] == x or right[y] == x):
            z = up[y]
            if z and (left[z] == y or right[z] == y):
                # two levels at once: the parent first where both lean the same way
                rotate(y if (left[z] == y) == (left[y] == x) else x)
                top = z
            else:
                top = y
            rotate(x)
            y = up[x]
            self.colour[x] = self.colour[top]

    def _rotate(self, x: int) -> None:
        """x takes the place of its parent in the splay tree."""
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if left[y] == x:
            left[y] = inside = right[x]
            right[x] = y
        else:
            right[y] = inside = left[x]
            left[x] = y
        if inside:
            up[inside] = y
        up[y] = x
        up[x] = z
        if z:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x

    def access(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Recolour the path from ``node`` to its root; (deepest node, colour before) of the segments it was made of."""
        up, right, colours, splay = self.up, self.right, self.colour, self.splay
        met, below, x = [], 0, node
        while x:
            splay(x)
            before = colours[x]
            met.append((x, before))
            deeper = right[x]
            if deeper:
                colours[deeper] = before
            right[x] = below
            below = x
            x = up[x]
        splay(node)
        colours[node] = colour
        return met


def runs_of(words: Sequence[int], least: int) -> list[Run]:
    """(start, length, period) of all runs of at least ``least`` words and two periods in a stretch of numbered words."""
    link, longest, prefixes = suffix_automaton(words)
    paths = LinkCutPaths(link)
    ends: dict[tuple[int, int], int] = {}
    for place, state in enumerate(prefixes):
        for node, before in paths.access(state, place):
            if before >= 0 and place - before <= longest[node]:
                ends[before - longest[node] + 1, place - before] = place
    return [(start, end - start + 1, period) for (start, period), end in ends.items()
            if end - start + 1 >= max(least, 2 * period)]


def repeated_stretches(words: np.ndarray, window: int) -> list[tuple[int, int]]:
    """[start, stop) of the stretches whose words lie in windows that occur more than once, by a hash of the window."""
    if len(words) <= window:
        return []
    mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    value = np.zeros(len(words) - window + 1, dtype=np.uint64)
    for k in range(window):
        value = value * np.uint64(0xBF58476D1CE4E5B9) + mixed[k: k + len(value)]
    order = np.argsort(value, kind="stable")
    same = value[order[1:]] == value[order[:-1]]
    repeated = np.zeros(len(value), dtype=bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    starts = np.nonzero(repeated)[0]
    change = np.zeros(len(words) + 1, dtype=np.int64)
    change[starts] += 1
    change[starts + window] -= 1
    covered = np.concatenate([[0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]])
    turns = np.nonzero(np.diff(covered))[0]
    return list(zip(turns[::2].tolist(), turns[1::2].tolist()))


def text_runs(data: bytes, least: int = LEAST_WORDS) -> tuple[int, list[Run], bytes]:
    """Number of words, runs by start and period, and the words outside the repeats joined by one space."""
    # splitting bytes at white space cuts at U+0020 and U+0009 to U+000D, and nowhere else
    words = data.split()
    number: dict[bytes, int] = defaultdict(count().__next__)
    numbered = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
    runs = []
    for start, stop in repeated_stretches(numbered, -(-least // 2)):
        runs += [(start + at, length, period) for at, length, period in runs_of(numbered[start:stop].tolist(), least)]
    if not runs:
        return len(words), [], b" ".join(words)
    runs.sort(key=lambda run: (run[0], run[2]))
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.nonzero(np.cumsum(change[:-1]) == 0)[0]
    return len(words), runs, b" ".join([words[k] for k in kept])


def find_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, its runs by start and period, and the text without the repeats.

    A run is a stretch of at least ``least`` words and two of its smallest periods that
    no neighbouring word extends. The collapsed text drops the words that a run contains
    after its first period. Rows are searched alone, without a shuffle.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size, first = [], 0, 0
            for place, text in enumerate(batch.column(1)):
                found.append(text_runs(text.as_py(), least))
                size += len(found[-1][2])
                if size >= OUT_BYTES or place + 1 == batch.num_rows:
                    yield _found_batch(batch.column(0)[first: place + 1], found)
                    found, size, first = [], 0, place + 1

    return rows.mapInArrow(search, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {FOUND}")


def _found_batch(ids: pa.Array, found: list[tuple[int, list[Run], bytes]]) -> pa.RecordBatch:
    runs = [[{"start": s, "length": n, "period": p} for s, n, p in f[1]] for f in found]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([f[0] for f in found], pa.int64()), pa.array(runs, pa.list_(RUN)),
         pa.array([f[2].decode("utf-8", "replace") for f in found], pa.string())],
        names=["doc_id", "n_words", "runs", "collapsed"])


def with_planted_loops(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which one document in ten repeats its last words periodically from a place given by its id.

    With h = crc32 of the decimal id and g = floor(h / 10), in documents of n words with h % 10 = 0
    each word i >= a becomes word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"),
                       F.when(h % 10 == 0, split_words("coalesce(text, '')", BETWEEN_WORDS)).alias("w"))
    rows = rows.select("*", F.size("w").alias("n")).select(
        "*", F.expr("CASE WHEN n > 0 THEN cast(g % n AS int) END").alias("a"))
    rows = rows.select("*", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) AS int)").alias("p"))
    looped = F.expr("array_join(transform(w, (x, i) -> CASE WHEN i < a THEN x ELSE w[a + (i - a) % p] END), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, looped).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of the result of ``find_runs``."""
    longest: Column = F.expr("array_max(transform(runs, r -> struct(r.length AS n, -r.start AS s, -r.period AS p)))")
    lines = F.expr(r"array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || chr(10)), '')")
    return found.withColumn("_longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_longest.s")).alias("start"),
        F.col("_longest.n").alias("length"), (-F.col("_longest.p")).alias("period"),
        F.expr("(1000 * _longest.n) div (-_longest.p)").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
