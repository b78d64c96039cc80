"""From raw documents to packed training sequences, in five stages that each write a table.

A stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of
``documents``; the last returns the packed pieces. A stage without rows hands an
empty table on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haulcast.llm import exact_dedup, mixing, near_dedup, packing, quality
from haulcast.llm.registry import table
from haulcast.session import materialise

# The stage drops pairs at 0.8 or more (op10 at 0.85). A pair at exactly 0.8
# shares none of 49 bands of 7 hashes with a probability of 1e-5.
NEAR_PERCENT, NEAR_BANDS, NEAR_ROWS = 80, 49, 7
# fewer words remembered than in op2 alone: the workers of the stages before still hold memory
PACKING_WORDS = 100_000
#: Rows in an Arrow batch: whole texts of 10,000 documents, Spark's default, take too much memory beside the heap.
ARROW_ROWS = 1_000
ARROW_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches; it stays so, as a stage's rows are computed after its function returns."""
    given = int(spark.conf.get(ARROW_SETTING))
    # zero or less means no limit
    spark.conf.set(ARROW_SETTING, str(min(given, ARROW_ROWS) if given > 0 else ARROW_ROWS))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject; it learns from ``labels`` of the documents given."""
    small_batches(spark)
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    small_batches(spark)
    return near_dedup.drop_near_duplicates(docs, NEAR_PERCENT, NEAR_BANDS, NEAR_ROWS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts that the mix of sources takes, some of them more than once."""
    small_batches(spark)
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    small_batches(spark)
    return packing.pack(docs, remembered=PACKING_WORDS)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("source_mix", source_mix),
    ("packing", packed),
]

#: A compression model and a tokenizer are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
