"""Mixing sources to target weights.

The words of each source, in the order of its documents, are packed into blocks of
a fixed number of words. The output is a row of shards with a fixed number of
slots. Each shard draws its source counts from one multinomial distribution with a
seed of its own; a source's n-th slot takes the block that a pseudorandom
permutation of its block numbers puts there (another permutation on every pass),
and blocks meet slots by a join on their number. No shard needs another one, and
no block list is shuffled or held anywhere.

A multinomial draw misses a source's quota by about its square root. The few slots
beyond one source's quota are therefore handed to sources that stayed below, so
each source gets its quota to the slot, and no block is used more than the limit.

Edge cases: a null or empty text has no words, target and taken are its source's
and 0. A null source is a source of its own, after all others. Ids may be null or
repeated; each row is a document of its own. A table without words mixes nothing.
Columns besides doc_id, text and source are ignored or, in ``mixed_documents``,
carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulcast.llm.text import WORD
from haulcast.operators.keyed import KeyedTable
from haulcast.session import materialise

WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix as a share of all words, and how often a source may be repeated.
SHARE, LIMIT = 1.5, 2
BLOCK_WORDS = 64
# a source has at least so many blocks, or blocks of one word
LEAST_BLOCKS = 64
SHARD_SLOTS = 1 << 16
#: Slots that one task lists.
TASK_SLOTS = 500_000
#: Documents whose taken texts are built at a time.
SLICE_ROWS = 500
SEED = 20_240_601

_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def water_fill(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, limit: float = LIMIT) -> np.ndarray:
    """Targets by weight, none above ``limit`` times its size; the excess is shared again by weight."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    targets, open_ = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    left = min(share, limit) * sizes.sum()
    while open_.any():
        part = left * weights / weights[open_].sum()
        over = open_ & (part >= limit * sizes)
        if not over.any():
            targets[open_] = part[open_]
            break
        targets[over] = limit * sizes[over]
        left -= targets[over].sum()
        open_ &= ~over
    return targets


@dataclass
class Sources:
    """Sizes, targets, words of a block, blocks and slots by source; one number each, also on the driver.

    A source of few words has shorter blocks, so that half a block is little beside its target.
    """

    keys: list[str]
    sizes: np.ndarray
    targets: np.ndarray
    block: np.ndarray
    blocks: np.ndarray
    slots: np.ndarray

    @classmethod
    def of(cls, keys: list[str], sizes: list[int], weights: Sequence[float], share: float, limit: int, block: int,
           seed: int = SEED) -> "Sources":
        sizes = np.asarray(sizes, np.int64)
        targets = water_fill(sizes, [weights[k % len(weights)] for k in range(len(sizes))], share, limit)
        lengths = np.clip(sizes // LEAST_BLOCKS, 1, block)
        blocks = -(-sizes // lengths)
        slots = [slots_near(t, int(n), int(b), limit, s, seed) for s, (t, n, b) in enumerate(zip(targets, sizes, lengths))]
        return cls(keys, sizes, targets, lengths, blocks, np.array(slots, dtype=np.int64))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(self.keys, range(len(self.keys)), self.sizes.tolist(), self.targets.tolist(), self.block.tolist()))
        return spark.createDataFrame(rows, "_key string, _s int, source_size long, target double, _length long")


def slots_near(target: float, size: int, block: int, limit: int, source: int, seed: int) -> int:
    """The number of slots whose blocks hold the number of words nearest to the target.

    All blocks but the last have ``block`` words. Whether the short one is among those
    that the unfinished pass takes is known beforehand from the inverse permutation.
    """
    if not size:
        return 0
    blocks = -(-size // block)
    turn = min(int(target // size), limit)
    if turn == limit:
        return limit * blocks
    lost = blocks * block - size
    short_at = int(permuted(blocks - 1, blocks, pass_seed(seed, source, turn), back=True)[0])
    rest = target - turn * size
    near = {min(blocks, int(rest // block) + k) for k in range(3)}
    return turn * blocks + min(near, key=lambda k: (abs(k * block - lost * (short_at < k) - rest), k))


def pass_seed(seed: int, source, turn) -> np.ndarray:
    """Seed of the permutation of a source's blocks in a pass."""
    source, turn = (np.asarray(x).astype(np.uint64) for x in (source, turn))
    return np.uint64(seed) + source * np.uint64(1_000_003) + turn * np.uint64(7_919)


def _key(source: Column) -> Column:
    """Text that tells a null source from all others and sorts it last (prefixes 0 and 1)."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def permuted(index: np.ndarray, size: np.ndarray, seed: np.ndarray, back: bool = False) -> np.ndarray:
    """Element ``index`` of a pseudorandom permutation of 0 .. size - 1; with ``back`` the place of an element.

    Four rounds of a Feistel network on the smallest even number of bits, repeated
    for the values that fall outside.
    """
    index, size, seed = (np.atleast_1d(x).astype(np.uint64) for x in np.broadcast_arrays(index, size, seed))
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2).astype(float))) / 2 + 0.5).astype(np.uint64))
    half += ((np.uint64(1) << (half + half)) < size).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.copy(), np.arange(len(index))
    while len(todo):
        h, m, s = half[todo], mask[todo], seed[todo]
        left, right = out[todo] >> h, out[todo] & m
        for k in range(3, -1, -1) if back else range(4):
            x = (left if back else right) + s + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
            for shift, factor in zip((30, 27), _MIX):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
            mixed = (x ^ (x >> np.uint64(31))) & m
            left, right = (right ^ mixed, left) if back else (right, left ^ mixed)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def _positions(sized: DataFrame) -> DataFrame:
    """Adds ``_start``, the words of the source before the document.

    Rows are range partitioned by source and id, so a source with most of the rows
    takes most of the partitions; a running sum inside each is shifted by what the
    partitions before it hold of the source.
    """
    schema = "_row long, _s int, size long, _length long, _inside long, _part int"

    def running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, words = None, 0
        for b in batches:
            before = b["size"].cumsum() - b["size"]
            first = b["_s"].ne(b["_s"].shift())
            inside = before - before.where(first).ffill()
            if len(b) and b["_s"].iloc[0] == source:
                inside += words * (~first.iloc[1:]).cummin().reindex(b.index, fill_value=True)
            if len(b):
                source, words = b["_s"].iloc[-1], int(inside.iloc[-1] + b["size"].iloc[-1])
            yield b[["_row", "_s", "size", "_length"]].assign(_inside=inside.astype("int64"), _part=b["_part"])

    order = ["_s", "doc_id", "size", "_row"]
    ranged = sized.select(*order, "_length").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(ranged.withColumn("_part", F.spark_partition_id())
                         .select("_row", "_s", "size", "_length", "_part").mapInPandas(running, schema), "positions")
    parts = placed.groupBy("_s", "_part").agg(F.sum("size").alias("_words"))
    before = F.sum("_words").over(Window.partitionBy("_s").orderBy("_part")) - F.col("_words")
    bases = parts.select(F.col("_s").alias("_bs"), F.col("_part").alias("_bp"), before.alias("_base"))
    joined = placed.join(bases, (F.col("_s") == F.col("_bs")) & (F.col("_part") == F.col("_bp")))
    return joined.select("_row", "_s", "size", "_length", (F.col("_base") + F.col("_inside")).alias("_start"))


def _pieces(positions: DataFrame) -> DataFrame:
    """Blocks by the documents they cut: (_row, _s, _block, from_word, words)."""
    block = F.col("_length")
    first, last = F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("size") - 1) / block)
    cut = positions.filter("size > 0").select("*", F.explode(F.sequence(first, last)).alias("_block"))
    start = F.greatest(F.col("_block") * block - F.col("_start"), F.lit(0))
    end = F.least((F.col("_block") + 1) * block - F.col("_start"), F.col("size"))
    return cut.select("_row", "_s", "_block", start.alias("from_word"), (end - start).alias("words"))


def _slots(spark: SparkSession, sources: Sources, shard_slots: int, seed: int) -> DataFrame:
    """All slots of the mix: (shard, slot, _s, _block)."""
    total = int(sources.slots.sum())
    shards = -(-total // shard_slots)
    share = sources.slots / max(total, 1)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard in b["id"]:
                size = min(shard_slots, total - int(shard) * shard_slots)
                counts = np.random.Generator(np.random.Philox(key=[seed, int(shard)])).multinomial(size, share)
                yield pd.DataFrame({"shard": shard, "_s": np.arange(len(share), dtype=np.int32), "_count": counts})

    counts = materialise(spark.range(shards).mapInPandas(draw, "shard long, _s int, _count long"), "counts")
    drawn = np.zeros(len(share), np.int64)
    for s, n in counts.groupBy("_s").agg(F.sum("_count")).collect():  # one number per source
        drawn[s] = n
    quota = sources.slots
    # surplus slots of all sources in a row, met by the missing slots of the others in a row: both are as many
    surplus = np.concatenate([[0], np.cumsum(np.maximum(drawn - quota, 0))])
    missing = np.concatenate([[0], np.cumsum(np.maximum(quota - drawn, 0))])
    block_counts = sources.blocks

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, s, count, before in zip(b["shard"], b["_s"], b["_count"], b["_before"]):
                nth = int(before) + np.arange(int(count))
                source = np.full(len(nth), s)
                over = nth >= quota[s]
                spare = surplus[s] + nth[over] - quota[s]
                source[over] = to = np.searchsorted(missing, spare, side="right") - 1
                nth[over] = drawn[to] + spare - missing[to]
                size = block_counts[source]
                turn = nth // size
                block = permuted(nth - turn * size, size, pass_seed(seed, source, turn))
                yield pd.DataFrame({"shard": shard, "_s": source.astype(np.int32), "_block": block, "_nth": nth})

    before = F.sum("_count").over(Window.partitionBy("_s").orderBy("shard")) - F.col("_count")
    tasks = max(1, min(shards, -(-total // TASK_SLOTS)))
    filled = (counts.withColumn("_before", before).filter("_count > 0").repartition(tasks)
              .mapInPandas(fill, "shard long, _s int, _block long, _nth long"))
    # the order inside a shard is that of a hash
    return filled.withColumn("slot", F.xxhash64(F.lit(seed), "_s", "_nth")).drop("_nth")


@dataclass
class Mix:
    """A planned mix: ``rows`` has every document with its source's size and target, ``pieces`` what the mix takes."""

    rows: DataFrame
    pieces: DataFrame
    sources: Sources


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: int = LIMIT,
        block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> Mix:
    """Plan the mix of documents that have a ``_row`` number in a written table.

    ``rows``: _row, doc_id, size, source_size, target. ``pieces``: shard, slot, _row,
    from_word, words; a mixed shard is its pieces in the order of slot and from_word.
    """
    spark = docs.sparkSession
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    sized = materialise(docs.select("_row", "doc_id", _key(F.col("source")).alias("_key"), words.alias("size")), "sizes")
    totals = {r["_key"]: r["words"] for r in sized.groupBy("_key").agg(F.sum("size").alias("words")).collect()}
    keys = sorted(totals)  # code points, null last
    sources = Sources.of(keys, [totals[k] for k in keys], weights, share, limit, block_words, seed)
    rows = KeyedTable.of(materialise(sources.table(spark), "sources"), "_key").attach(sized)
    pieces = _pieces(_positions(rows))
    slots = _slots(spark, sources, shard_slots, seed)
    # both sides grow with the corpus, although the slots come from a short table
    taken = slots.join(pieces.hint("merge"), ["_s", "_block"]).select("shard", "slot", "_row", "from_word", "words")
    return Mix(rows.select("_row", "doc_id", "size", "source_size", "target"), taken, sources)


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    plan = mix(docs.select("doc_id", "text", "source", F.monotonically_increasing_id().alias("_row")), **options)
    taken = plan.pieces.groupBy("_row").agg(F.sum("words").alias("_taken"))
    joined = plan.rows.join(taken, "_row", "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``docs``: a row for each piece taken, with its own text and n_chars.

    Pieces of one document that follow each other, taken equally often, come as one
    text, so a document that is taken whole stays whole.
    """
    # own names while helper columns are beside the caller's
    name = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    numbered = materialise(docs.toDF(*name.values()).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    plan = mix(numbered.select("_row", *[F.col(name[c]).alias(c) for c in ("doc_id", "text", "source")]), **options)
    spans = plan.pieces.groupBy("_row").agg(F.collect_list(F.struct("from_word", "words")).alias("_spans"))
    joined = numbered.join(spans, "_row").drop("_row")
    schema = joined.drop("_spans").schema
    text_column, length_column = name["text"], name.get("n_chars")

    def slice_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(WORD)
        for b in (whole.slice(k, SLICE_ROWS) for whole in batches for k in range(0, whole.num_rows, SLICE_ROWS)):
            at, texts = [], []
            for k, (cell, spans) in enumerate(zip(b.column(text_column), b.column("_spans"))):
                text = cell.as_py()
                places = [m.span() for m in word.finditer(text)]
                for start, end in runs([(s["from_word"], s["words"]) for s in spans.as_py()]):
                    at.append(k)
                    texts.append(text[places[start][0]: places[end - 1][1]])
            made = {text_column: texts, length_column: [len(t) for t in texts]}
            own = [f for f in b.schema if f.name != "_spans"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(made[f.name], f.type) if f.name in made else b.column(f.name).take(pa.array(at, pa.int64())) for f in own],
                names=[f.name for f in own])

    return joined.mapInArrow(slice_texts, schema).toDF(*docs.columns)


def runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges (from, to) that cover the spans as often as they occur, neighbours joined."""
    out, layers = [], {}
    for start, words in spans:
        layers.setdefault(start, []).append(start + words)
    open_: dict[int, list[int]] = {}  # by end: starts of ranges that end there
    for start in sorted(layers):
        for end in layers[start]:
            first = open_[start].pop() if open_.get(start) else start
            open_.setdefault(end, []).append(first)
    for end, starts in open_.items():
        out.extend((s, end) for s in starts)
    return sorted(out)
