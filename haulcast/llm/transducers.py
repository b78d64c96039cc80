"""Weighted acyclic automata over words: phrases of bounded length and their counts.

A transducer is built from sorted phrases. When the sorted input leaves a prefix, the
state below it is finished: if an equal state (same labels, weights and targets) is in
the register, that one is used, else it is added. The weight of an arc is the count of
the phrase that ends with it. Labels are places in the sorted list of words, from 1;
0 pads short phrases.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa

# rows of phrases held unsummed while transducers are united
PENDING = 4_000_000
FIELDS = [("words", pa.binary()), ("first", pa.list_(pa.int32())), ("label", pa.list_(pa.int32())),
          ("weight", pa.list_(pa.int64())), ("target", pa.list_(pa.int32()))]
SCHEMA = "words binary, first array<int>, label array<int>, weight array<long>, target array<int>"


def packed(phrases: np.ndarray, labels: int) -> np.ndarray | None:
    """One sortable number per phrase, or None where labels are too many for 63 bits."""
    bits = max(1, labels.bit_length())
    if phrases.shape[1] * bits > 63:
        return None
    key = phrases[:, 0].astype(np.int64)
    for d in range(1, phrases.shape[1]):
        key = (key << bits) | phrases[:, d]
    return key


def sorted_order(phrases: np.ndarray, labels: int) -> np.ndarray:
    key = packed(phrases, labels)
    return np.lexsort(phrases.T[::-1]) if key is None else np.argsort(key)


def _new_prefix(phrases: np.ndarray, length: int) -> np.ndarray:
    """True where the first ``length`` labels differ from those of the row before."""
    out = np.ones(len(phrases), dtype=bool)
    if length == 0:
        out[1:] = False
    elif len(phrases):
        out[1:] = (phrases[1:, :length] != phrases[:-1, :length]).any(axis=1)
    return out


def summed(phrases: np.ndarray, weights: np.ndarray, labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases in sorted order and their total weights."""
    if not len(phrases):
        return phrases, weights
    order = sorted_order(phrases, labels)
    phrases, weights = phrases[order], weights[order]
    starts = np.nonzero(_new_prefix(phrases, phrases.shape[1]))[0]
    return phrases[starts], np.add.reduceat(weights, starts)


@dataclass
class CountTransducer:
    """States with their arcs; the arcs of state s are ``first[s]`` to ``first[s + 1]``, the root is the last state."""

    words: list[bytes]
    first: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    target: np.ndarray

    @classmethod
    def build(cls, words: list[bytes], phrases: np.ndarray, weights: np.ndarray) -> "CountTransducer":
        """From distinct phrases in sorted order; state 0 has no arcs."""
        register: dict[bytes, int] = {b"": 0}
        arcs: list[bytes] = [b""]
        below, rows = None, np.arange(len(phrases))
        for d in range(phrases.shape[1] - 1, -1, -1):
            inner = phrases[:, d] > 0
            level, at = phrases[inner], rows[inner]
            nodes = np.nonzero(_new_prefix(level, d + 1))[0]
            ends_here = np.ones(len(nodes), dtype=bool) if d + 1 == phrases.shape[1] else level[nodes, d + 1] == 0
            cells = np.zeros((len(nodes), 3), dtype=np.int64)
            cells[:, 0] = level[nodes, d]
            cells[:, 1] = np.where(ends_here, weights[at[nodes]], 0)
            if below is not None:
                # a node's first row lies before the first row of each longer phrase below it
                parents = np.searchsorted(at[nodes], below[0], side="right") - 1
                cells[parents, 2] = below[1]
            groups = np.nonzero(_new_prefix(level[nodes], d))[0]
            data, states = cells.tobytes(), []
            for start, stop in zip(groups.tolist(), [*groups[1:].tolist(), len(nodes)]):
                state = data[24 * start: 24 * stop]
                found = register.get(state)
                if found is None:
                    found = register[state] = len(arcs)
                    arcs.append(state)
                states.append(found)
            below = at[nodes[groups]] if len(groups) else at[:0], np.array(states, dtype=np.int64)
        if not len(phrases):
            arcs.append(b"")
        cells = np.frombuffer(b"".join(arcs), dtype=np.int64).reshape(-1, 3)
        first = np.concatenate([[0], np.cumsum([len(a) // 24 for a in arcs])])
        return cls(words, first.astype(np.int32), cells[:, 0].astype(np.int32), cells[:, 1].copy(), cells[:, 2].astype(np.int32))

    def paths(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """All phrases with a weight, padded to ``depth`` labels, and the weights."""
        prefix, state = np.zeros((1, depth), dtype=np.int64), np.array([len(self.first) - 2])
        phrases, weights = [prefix[:0]], [self.weight[:0]]
        for d in range(depth):
            sizes = self.first[state + 1] - self.first[state]
            total = int(sizes.sum())
            arc = np.repeat(self.first[state] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
            prefix = np.repeat(prefix, sizes, axis=0)
            prefix[:, d] = self.label[arc]
            counted = self.weight[arc] > 0
            phrases.append(prefix[counted])
            weights.append(self.weight[arc][counted])
            state = self.target[arc]
        return np.concatenate(phrases), np.concatenate(weights)

    @cached_property
    def _arc_keys(self) -> np.ndarray:
        """Sorted numbers of (state, label)."""
        state = np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first))
        return (state << 32) | self.label

    def compose(self, asked: "CountTransducer", depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of ``asked`` in its own labels, and their weights here (0 where there are none).

        Both automata are walked side by side, all phrases one label at a time.
        """
        phrases, _ = asked.paths(depth)
        place = {word: k + 1 for k, word in enumerate(self.words)}
        own = np.array([0, *[place.get(word, -1) for word in asked.words]], dtype=np.int64)[phrases]
        state = np.full(len(phrases), len(self.first) - 2, dtype=np.int64)
        weights = np.zeros(len(phrases), dtype=np.int64)
        for d in range(depth):
            walking = np.nonzero(phrases[:, d] > 0)[0]
            key = (state[walking] << 32) | np.maximum(own[walking, d], 0)
            arc = np.searchsorted(self._arc_keys, key)
            arc = np.minimum(arc, len(self._arc_keys) - 1)
            found = (own[walking, d] > 0) & (self._arc_keys[arc] == key) if len(self._arc_keys) else np.zeros(len(key), bool)
            weights[walking] = np.where(found, self.weight[arc], 0) if len(self._arc_keys) else 0
            state[walking] = np.where(found, self.target[arc], 0) if len(self._arc_keys) else 0
        return phrases, weights

    def row(self) -> list:
        return [b"\n".join(self.words), self.first, self.label, self.weight, self.target]

    @classmethod
    def of_row(cls, words: bytes, *arrays: np.ndarray) -> "CountTransducer":
        return cls(words.split(b"\n") if words else [], *arrays)


def transducers(table: pa.Table | pa.RecordBatch) -> Iterable[CountTransducer]:
    """The transducers in the rows of an Arrow table."""
    columns = [table.column(name) for name, _ in FIELDS]
    for k in range(table.num_rows):
        words, *arrays = [c[k] for c in columns]
        yield CountTransducer.of_row(words.as_py(), *[a.values.to_numpy() for a in arrays])


def columns(found: list[CountTransducer]) -> list[pa.Array]:
    """Arrow columns of transducers, in the order of ``FIELDS``."""
    cells = zip(*[t.row() for t in found]) if found else [[]] * len(FIELDS)
    return [pa.array(list(c), kind) for c, (_, kind) in zip(cells, FIELDS)]


def of_sorted_words(number: dict[bytes, int], phrases: np.ndarray, weights: np.ndarray) -> CountTransducer:
    """Transducer over distinct phrases whose labels follow ``number`` (from 1), which holds words in any order."""
    used = np.unique(phrases)
    used = used[used > 0]
    listed = list(number)
    words = sorted((listed[k - 1], k) for k in used.tolist())
    rank = np.zeros(len(number) + 1, dtype=np.int64)
    rank[[k for _, k in words]] = np.arange(1, len(words) + 1)
    phrases = rank[phrases]
    order = sorted_order(phrases, len(words))
    return CountTransducer.build([w for w, _ in words], phrases[order], weights[order])


def union(parts: Iterable[CountTransducer], depth: int, least: int = 1) -> tuple[CountTransducer, int]:
    """Transducer of the summed weights, without phrases below ``least``; and the sum over all single words."""
    number: dict[bytes, int] = defaultdict(count(1).__next__)
    phrases, weights = np.zeros((0, depth), dtype=np.int64), np.zeros(0, dtype=np.int64)
    pending, held = [], 0

    def sum_up():
        return summed(np.concatenate([phrases, *[p for p, _ in pending]]),
                      np.concatenate([weights, *[w for _, w in pending]]), len(number))

    for part in parts:
        renumber = np.array([0, *map(number.__getitem__, part.words)], dtype=np.int64)
        more, counts = part.paths(depth)
        pending.append((renumber[more], counts))
        held += len(counts)
        if held >= max(PENDING, len(phrases)):
            phrases, weights = sum_up()
            pending, held = [], 0
    phrases, weights = sum_up()
    singles = int(weights[phrases[:, 1] == 0].sum())
    often = weights >= least
    return of_sorted_words(number, phrases[often], weights[often]), singles
