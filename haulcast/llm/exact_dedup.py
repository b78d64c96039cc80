"""Exact duplicates by two passes over a Bloom filter, in DataFrame operations only.

The first pass marks, for each text hash, two bits of one 64-bit word of a Bloom
filter and keeps the bits that were hit at least twice. The second pass tests each
row against that filter. A repeated text hits its own bits twice, so no duplicate
can fail the test; the rows that fail it are unique and pass straight through.
Only the rest, duplicates and about one unique row in a hundred, is shuffled and
grouped by SHA-256 of the whole text.

Edge cases: a null text counts as empty, and empty texts are copies of each other.
Ids may be null (below every other id) or repeated; among rows with the same text
and the same largest id exactly one stays. An empty table gives an empty result.
Columns besides doc_id and text are carried or ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.llm.text import ascii_lower
from haulcast.operators.keyed import KeyedTable
from haulcast.session import materialise

BITS_PER_ROW = 16
# A filter up to this many words is broadcast (8 bytes of key and 8 of bits each); a larger one is joined by shuffle.
BROADCAST_WORDS = 4_000_000


def text_hash(text: str | Column = "text") -> Column:
    """SHA-256 of the normalised text as 32 bytes."""
    return F.unhex(F.sha2(ascii_lower(text).cast("binary"), 256))


def _word(digest: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(words))


def _bits(digest: Column) -> tuple[Column, Column]:
    """Two different bits of the word."""
    spread = F.xxhash64(digest, F.lit(1))
    first = F.pmod(spread, F.lit(64)).cast("int")
    step = F.pmod(F.shiftrightunsigned(spread, 20), F.lit(63)).cast("int")
    return first, (first + 1 + step) % 64


def _bit(position: Column) -> Column:
    """A long with one bit set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), position)


def repeated_bits(hashes: DataFrame, words: int) -> DataFrame:
    """First pass: (word, bits), the filter bits that two or more rows hit; counted before and after the shuffle."""
    digest = F.col("digest")
    hits = hashes.select(_word(digest, words).alias("_word"), F.explode(F.array(*_bits(digest))).alias("_bit"))
    twice = hits.groupBy("_word", "_bit").agg(F.count("*").alias("_hits")).filter("_hits > 1")
    return twice.groupBy("_word").agg(F.bit_or(_bit(F.col("_bit"))).alias("_bits"))


def flag_possible_repeats(df: DataFrame, digest: str, repeated: DataFrame, words: int) -> DataFrame:
    """Second pass: ``_maybe`` tells the rows whose bits were all hit twice."""
    first, second = _bits(F.col(digest))
    side = F.broadcast(repeated) if words <= BROADCAST_WORDS else repeated
    mask = _bit(first).bitwiseOR(_bit(second))
    tested = df.withColumn("_row_word", _word(F.col(digest), words)).join(side, F.col("_row_word") == F.col("_word"), "left")
    passed = F.coalesce(F.col("_bits").bitwiseAND(mask) == mask, F.lit(False))
    return tested.withColumn("_maybe", passed).drop("_row_word", "_word", "_bits")


def _flagged(hashes: DataFrame) -> tuple[DataFrame, int]:
    words = max(1, hashes.count() * BITS_PER_ROW // 64)
    return materialise(repeated_bits(hashes, words), "bloom"), words


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    hashes = materialise(
        docs.select("doc_id", text_hash().alias("digest")).withColumn("_row", F.monotonically_increasing_id()), "hashes")
    repeated, words = _flagged(hashes)
    flagged = flag_possible_repeats(hashes, "digest", repeated, words)
    candidates = flagged.filter("_maybe").drop("_maybe")
    groups = (
        candidates.groupBy("digest")
        .agg(F.count("*").alias("_n"), F.max(F.struct("doc_id", "_row")).alias("_keep")).filter("_n > 1")
        .select("digest", "_n", F.col("_n").alias("_size"), F.col("_keep.doc_id").alias("_keep_id"),
                F.col("_keep._row").alias("_keep_row"))
    )
    grouped = KeyedTable.of(materialise(groups, "copies"), "digest", "_n").attach(candidates)
    single = F.col("_size").isNull()
    checked = grouped.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("_keep_id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("_row") == F.col("_keep_row"))).alias("kept"), "digest")
    unique = flagged.filter("not _maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "digest")
    return unique.unionAll(checked).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns.

    Rows that the filter clears keep their place. Of the others each task first
    reduces its own copies to one row per text, so a text that fills a third of
    the table moves one row per task. Ids that tie with the same text leave any
    one of the rows.
    """
    hashes = materialise(docs.select(text_hash().alias("digest")), "hashes")
    repeated, words = _flagged(hashes)
    # the caller's columns travel in one, apart from the helpers
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))
    flagged = flag_possible_repeats(packed.withColumn("_digest", text_hash("_doc.text")), "_digest", repeated, words)
    kept = flagged.filter("_maybe").groupBy("_digest").agg(F.max_by("_doc", "_doc.doc_id").alias("_doc")).select("_doc.*")
    return flagged.filter("not _maybe").select("_doc.*").unionAll(kept)
