"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: a word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
BETWEEN_WORDS = r"[\x20\x09-\x0D]+"


def ascii_lower(text: str | Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def split_words(text: str, between: str) -> Column:
    """Array of the words of a non-null text column, ``between`` being the pattern of what separates them.

    A text that starts or ends between words has an empty part there, which is cut
    off. Splitting is several times faster than extracting all matches of a pattern.
    """
    return F.expr(
        f"transform(array(split({text}, r'{between}')), p -> slice(p, 1 + int(p[0] = ''), "
        "size(p) - int(p[0] = '') - int(size(p) > 1 AND p[size(p) - 1] = '')))[0]")


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """True for the documents that no learner may see: crc32 of the id as text, fold 0. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int,
                    *extra: str) -> DataFrame:
    """At most ``per_class`` labelled texts of each class, as (doc_id, text, label, extra columns), for fitting.

    Only rows outside the held-out fold are taken, in the order of a hash of
    their id, so the sample is the same on every run. Documents with a null or
    contradictory label, without text or above ``max_chars`` are not learned
    from. Fewer than ``2 * per_class`` ids are broadcast, whatever the table size.
    """
    known = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .filter("label = other")
    )
    near = docs.select("doc_id", "text", *extra, F.length("text").alias("chars")).filter(F.col("chars").between(1, max_chars))
    ids = None
    for value in (0, 1):
        one = known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = one if ids is None else ids.unionAll(one)
    ids = ids.select(F.col("doc_id").alias("_id"), "label")
    return near.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label", *extra)
