"""Quality scores from compression with two dictionaries.

Zstandard dictionaries are built from well and badly rated texts. A text is cut
into blocks, each block is compressed with either dictionary, and the normalised
difference of the total sizes, (bad - good) / (bad + good), becomes a probability by
logistic calibration, for which each labelled text is measured with dictionaries
built without its fold; the final dictionaries are built from all folds. The
compression ratio takes part in the calibration, since text that only repeats
itself is small with any dictionary. Blocks are short so that a long text cannot
replace the dictionary by its own beginning; all blocks of a text count.

Edge cases: null and empty texts get the share of label 1. Ids may be null or
repeated; each row is scored by its text alone. With labels of one class only, or
none, every score is the share of label 1 (0.5 without labels).
An empty table gives an empty result. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.llm.text import held_out, labelled_sample

#: Bound of the fitting sample: labelled texts of each class, and characters of a text that is learned from.
PER_CLASS, MAX_CHARS = 2_000, 20_000
DICTIONARY_BYTES = 112 << 10
BLOCK_BYTES = 256
LEVEL = 3
FOLDS = 4
SHORT_BYTES = 100
THRESHOLD = 0.3


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False,
                                    write_dict_id=False)


def measures(text: str, good: bytes, bad: bytes) -> tuple[float, float, float]:
    """(bad - good) / (bad + good) of the sizes compressed with either dictionary; log ratio of the good size, and its square.

    All three are drawn towards 0 for texts of few bytes, which say little.
    """
    data = memoryview(text.encode("utf-8", "surrogatepass"))
    blocks = [data[k: k + BLOCK_BYTES] for k in range(0, len(data), BLOCK_BYTES)]
    of_good, of_bad = (sum(len(compress(b)) for b in blocks) for compress in
                       (_compressor(good).compress, _compressor(bad).compress))
    ratio, certainty = float(np.log(of_good / len(data))), len(data) / (len(data) + SHORT_BYTES)
    return (of_bad - of_good) / (of_bad + of_good + SHORT_BYTES), certainty * ratio, certainty * ratio * ratio


def build_dictionary(texts: Sequence[str], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; with too little text to train one, the text itself."""
    samples = [data[k: k + BLOCK_BYTES] for data in (t.encode("utf-8", "surrogatepass") for t in texts)
               for k in range(0, len(data), BLOCK_BYTES)]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> np.ndarray:
    """Coefficients, intercept last, by damped Newton steps with a small penalty; columns of ``x`` have unit spread."""
    design, b = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    penalty = np.diag([1e-2] * x.shape[1] + [1e-6])

    def loss(b: np.ndarray) -> float:
        z = design @ b
        return float(weight @ (np.logaddexp(0, z) - y * z) + b @ penalty @ b / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + penalty @ b
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + penalty, gradient)
        while np.abs(step).max() > 1e-9 and loss(b - step) > loss(b):
            step /= 2
        b = b - step
        if np.abs(step).max() < 1e-8:
            break
    return b


@dataclass(frozen=True)
class QualityModel:
    """``coefficients``: one per measure and the intercept; empty without dictionaries. ``share`` of label 1."""

    share: float = 0.5
    good: bytes = b""
    bad: bytes = b""
    coefficients: tuple[float, ...] = ()

    def of(self, text: str | None) -> float:
        if not text or not self.coefficients:
            return self.share
        *slopes, intercept = self.coefficients
        z = intercept + float(np.dot(slopes, measures(text, self.good, self.bad)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def score(self, text: Column) -> Column:
        """Probability of label 1."""

        @F.pandas_udf("double")
        def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([self.of(t) for t in texts], dtype="float64")

        return scores(text)


def fit_quality_texts(texts: Sequence[str], labels: Sequence[int], share: float) -> QualityModel:
    """Fit on texts in a random order; ``share`` is the share of label 1 among all labelled rows."""
    labels = np.asarray(labels, int)
    if min((labels == 0).sum(), (labels == 1).sum()) < 2:
        return QualityModel(share)
    rank = np.zeros(len(labels), int)
    for value in (0, 1):
        rank[labels == value] = np.arange((labels == value).sum())
    fold = rank % FOLDS

    def dictionaries(chosen: np.ndarray) -> tuple[bytes, bytes]:
        pick = lambda value: [t for t, y, c in zip(texts, labels, chosen) if c and y == value]
        return build_dictionary(pick(1)), build_dictionary(pick(0))

    x = np.zeros((len(labels), 3))
    for k in range(FOLDS):
        good, bad = dictionaries(fold != k)
        for i in np.flatnonzero(fold == k):
            x[i] = measures(texts[i], good, bad)
    good, bad = dictionaries(fold >= 0)
    y, centre, spread = labels, x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    weight = len(y) * np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum())
    *slopes, intercept = logistic((x - centre) / spread, y, weight)
    slopes = np.array(slopes) / spread
    return QualityModel(share, good, bad, (*slopes.tolist(), float(intercept - slopes @ centre)))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> QualityModel:
    """Fit on at most ``2 * per_class`` labelled documents outside the held-out fold."""
    share = labels.filter(F.col("quality").isin(0, 1) & ~held_out()).agg(F.avg("quality")).first()[0]
    if share is None:
        return QualityModel()
    sample = labelled_sample(docs, labels, "quality", per_class, max_chars).toPandas()
    sample = sample.sort_values("doc_id", key=lambda c: pd.util.hash_array(c.to_numpy()), kind="stable")
    return fit_quality_texts(sample["text"].tolist(), sample["label"].tolist(), share)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = docs.select("doc_id", held_out().alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold."""
    return docs.filter(model.score(F.col("text")) >= threshold)
