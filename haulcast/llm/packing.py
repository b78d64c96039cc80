"""Packing documents into token sequences by harmonic classes.

A piece of n tokens belongs to class j = capacity // n, and a sequence of class j
takes exactly j pieces, so a task needs no look at other tasks, and no search, to
fill it. Documents may be cut: whole sequences come off first; what remains is
kept in one piece where j such pieces leave at most 1/32 of a sequence empty, and
otherwise gives up its largest power of two. Pieces below 1/63 of a sequence share
one class filled by next fit. Sequences that a task could not complete are handed
on, far fewer each time, until one task holds a bounded rest and packs it by first
fit, longest pieces first.

Edge cases: a null or empty text has only the end token. Ids may be null or
repeated: each row is a document of its own. Equal texts are packed apart. An empty
table gives no pieces. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from haulcast.session import materialise

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2_048
END_ID = 1
#: Classes 1 to SMALL - 1 take a fixed number of pieces; shorter pieces are filled by next fit.
SMALL = 64
#: A piece stays whole if its class leaves at most this share of a sequence empty.
WASTE = 1 / 32
#: Unfinished pieces that one task takes on in a later round.
ROUND_ROWS = 50_000

#: Pieces handed to the engine at a time.
OUT_ROWS = 20_000
#: Words and parts of words whose ids a worker remembers; a full memory starts anew.
REMEMBERED = 400_000
# Fixed value: the pattern of the tokenizer file.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_NOT_LATIN = re.compile("[^\x01-\u012f]")
# Python's split takes these for white space, the tokenizer does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, klass int, "
          "sequence_id long, offset long")


class _Remembered(dict):
    """A memo of ``make`` that forgets everything at its limit."""

    def __init__(self, make: Callable[[str], bytes], limit: int, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


class WordIds:
    """Token ids of a text as little-endian 32-bit integers.

    The tokenizer never joins characters across white space, so a text's ids are
    those of its words in turn. A word of Latin letters is lower-cased and split by
    the tokenizer's own pattern, and each part goes straight to its merge table; in
    that range normalisation changes nothing else. Any other word takes the whole
    tokenizer. Both steps remember what they have seen, up to a limit.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        table = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {k: table.pre_tokenize_str(chr(k))[0][0] for k in range(1, 0x130)}
        self.parts = _Remembered(self._part, remembered)
        self.words = _Remembered(self._word, remembered)

    def encode(self, text: str) -> bytes:
        return _pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _part(self, part: str) -> bytes:
        return _pack([t.id for t in self.model.tokenize(part.translate(self.bytes))])

    def _word(self, word: str) -> bytes:
        if _NOT_LATIN.search(word) or "<|" in word:
            return self.encode(word)
        return b"".join([self.parts[p] for p in _PARTS.findall(word.lower())])

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _ODD_SPACE.search(text):
            return self.encode(text)
        return b"".join(map(self.words.__getitem__, text.split()))


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def word_ids(name: str, remembered: int = REMEMBERED) -> WordIds:
    return WordIds(public_tokenizers.path(name), remembered)


def cut(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document."""
    pieces = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        fits = capacity // rest
        whole = fits >= SMALL or fits * rest >= capacity * (1 - WASTE)
        pieces.append(rest if whole else 1 << (rest.bit_length() - 1))
        rest -= pieces[-1]
    return pieces


class Filler:
    """Open sequences of one task, one per class."""

    def __init__(self, first_id: int, capacity: int):
        self.next_id, self.capacity = first_id, capacity
        self.open: dict[int, list[tuple]] = {}
        self.used: dict[int, int] = {}

    def add(self, piece: tuple, out: list[tuple]) -> None:
        """Place (doc_id, start, length, crc, doc_tokens); completed sequences go to ``out``."""
        length = piece[2]
        klass = min(self.capacity // length, SMALL)
        pieces = self.open.setdefault(klass, [])
        if klass == SMALL and self.used.get(klass, 0) + length > self.capacity:
            self.close(pieces, klass, out)
        pieces.append(piece)
        self.used[klass] = self.used.get(klass, 0) + length
        if self.used[klass] == self.capacity or klass < SMALL and len(pieces) == klass:
            self.close(pieces, klass, out)

    def close(self, pieces: list[tuple], klass: int, out: list[tuple]) -> None:
        offset = 0
        for p in pieces:
            out.append((*p, klass, self.next_id, offset))
            offset += p[2]
        self.next_id += 1
        self.used[klass] = 0
        pieces.clear()

    def rest(self, out: list[tuple]) -> None:
        """Hand on the pieces of incomplete sequences, without a sequence."""
        for klass, pieces in self.open.items():
            out.extend((*p, klass, None, None) for p in pieces)

    def finish(self, out: list[tuple]) -> None:
        """Pack the pieces of incomplete sequences by first fit, longest first."""
        bins: list[tuple[list[tuple], list[int]]] = []
        for p in sorted((p for pieces in self.open.values() for p in pieces), key=lambda p: -p[2]):
            for pieces, used in bins:
                if used[0] + p[2] <= self.capacity:
                    break
            else:
                bins.append((pieces := [], used := [0]))
            pieces.append(p)
            used[0] += p[2]
        for pieces, _ in bins:
            self.close(pieces, 0, out)


def _first_id(level: int) -> int:
    """Sequence ids of one task in one round: 2^32 of them, 2^26 tasks a round."""
    return (level << 58) + (TaskContext.get().partitionId() << 32)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in PIECES.split(", ")]
    df = pd.DataFrame(rows, columns=names)
    return df.astype({c: "int32" if c == "klass" else "Int64" for c in names})


def _tokenize(name: str, capacity: int, end_id: int, remembered: int) -> Callable:
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, filler = word_ids(name, remembered), Filler(_first_id(0), capacity)
        out: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                data = memoryview(ids.of(text.as_py()) + end)
                tokens, start = len(data) // 4, 0
                for length in cut(tokens, capacity):
                    crc = zlib.crc32(data[4 * start: 4 * (start + length)])
                    filler.add((doc_id.as_py(), start, length, crc, tokens), out)
                    start += length
                if len(out) >= OUT_ROWS:
                    yield _batch(out)
                    out = []
        filler.rest(out)
        yield _batch(out)

    return run


def _batch(pieces: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(_frame(pieces), preserve_index=False)


def _refill(level: int, capacity: int, last: bool) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filler = Filler(_first_id(level), capacity)
        for batch in batches:
            out: list[tuple] = []
            columns = [batch[c].astype("Int64") for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            for piece in zip(*columns):
                filler.add(piece, out)
            yield _frame(out)
        out = []
        (filler.finish if last else filler.rest)(out)
        yield _frame(out)

    return run


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID,
         round_rows: int = ROUND_ROWS, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, klass.

    Every round is written, so a lost executor repeats only its own tasks. A round
    hands on at most some thousand pieces a task, and the next has a task for each
    ``round_rows`` of them.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    placed = materialise(texts.mapInArrow(_tokenize(tokenizer, capacity, end_id, remembered), PIECES), "pieces")
    done, level = placed.filter("sequence_id is not null"), 1
    open_, tasks = placed.filter("sequence_id is null"), None
    while rows := open_.count():
        # each round has at most half the tasks of the one before, however few rows a task may take on
        tasks = max(1, min(-(-rows // round_rows), tasks // 2 if tasks else rows))
        placed = materialise(open_.repartition(tasks).mapInPandas(_refill(level, capacity, tasks == 1), PIECES), "pieces")
        done = done.unionAll(placed.filter("sequence_id is not null"))
        open_, level = placed.filter("sequence_id is null"), level + 1
    return done.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "klass")
