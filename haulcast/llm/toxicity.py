"""Toxicity scores from a convolutional text classifier trained in NumPy.

A word is the mean of hashed embeddings of itself and its beginnings, so that
unseen endings of a known stem have a meaning. Filters of several widths slide
over all words of the text, the largest answer of each filter is kept, and a
logistic layer weighs them. Training takes a bounded labelled sample; a part kept
apart calibrates the score to the true share of toxic rows and sets, for each
language, the threshold of the decision ``toxic``. The language has no part in the
score.

Edge cases: null texts and texts without words have no filter answer and get the
score of the bias alone. Ids may be null or repeated; each row is scored by its
text. With labels of one class only, or none, every score is the share of label 1
(0 without labels). A null or unseen language has the threshold 0.5. An empty
table gives an empty result. Columns besides doc_id, text and lang are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.llm.quality import logistic
from haulcast.llm.text import held_out, labelled_sample

#: Bound of the fitting sample: labelled texts of each class, and characters of a text that is learned from.
PER_CLASS, MAX_CHARS = 2_500, 20_000
BUCKETS, DIMENSIONS = 1 << 16, 16
WIDTHS, FILTERS = (1, 2, 3), 12
BEGINNINGS = (3, 4, 5, 6)
EPOCHS, STEPS, BATCH, RATE, SEED = 6, 400, 32, 0.05, 7
CALIBRATION_FOLDS = 5
THRESHOLD = 0.5
#: Share of clean texts of a language that the decision may flag.
FALSE_ALARMS = 0.002

_WORDS = re.compile(r"\w+")
_CHUNK, _CACHED_WORDS = 1 << 16, 400_000


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def buckets_of(word: str) -> list[int]:
    """Hash buckets of a word and its beginnings; a short word repeats itself."""
    parts = [word, *(f"{word[:n]}~" if len(word) >= n else word for n in BEGINNINGS)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


@dataclass
class Network:
    """Weights: embeddings, filters[width][offset, dimension, filter], output weights and bias."""

    embeddings: np.ndarray
    filters: list[np.ndarray]
    output: np.ndarray
    bias: float

    @classmethod
    def start(cls, seed: int) -> "Network":
        rng = np.random.default_rng(seed)
        scale = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        return cls(0.01 * scale(BUCKETS, DIMENSIONS), [0.3 * scale(w, DIMENSIONS, FILTERS) for w in WIDTHS],
                   0.3 * scale(len(WIDTHS) * FILTERS), 0.0)


def train(texts: Sequence[list[str]], labels: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Network:
    """Adagrad on the log loss, at least ``EPOCHS`` times over the texts and ``steps`` batches; only the windows that
    win the pooling get a gradient."""
    net, rng = Network.start(seed), np.random.default_rng(seed)
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in words], np.int64) for words in texts]
    parts = np.array([buckets_of(w) for w in index], np.int64).reshape(len(index), -1)
    sums = [np.full_like(net.embeddings, 1e-6), [np.full_like(f, 1e-6) for f in net.filters], np.full_like(net.output, 1e-6)]
    bias_sum = 1e-6
    step = lambda w, g, s: (s.__iadd__(g * g), w.__isub__(RATE * g / np.sqrt(s)))
    batches = max(1, len(docs) // BATCH)
    for _ in range(max(EPOCHS, -(-steps // batches))):
        order = rng.permutation(len(docs))
        for batch in np.array_split(order, batches):
            grads = [np.zeros_like(f) for f in net.filters]
            out_grad, bias_grad = np.zeros_like(net.output), 0.0
            touched, deltas = [], []
            for d in batch:
                ids = docs[d]
                x = net.embeddings[parts[ids]].mean(axis=1)
                pooled, wins = np.zeros(len(net.output), np.float32), []
                for k, (width, f) in enumerate(zip(WIDTHS, net.filters)):
                    n = len(ids) - width + 1
                    if n <= 0:
                        wins.append(None)
                        continue
                    answers = sum(x[j: j + n] @ f[j] for j in range(width))
                    at = answers.argmax(axis=0)
                    best = answers[at, np.arange(FILTERS)]
                    pooled[k * FILTERS:(k + 1) * FILTERS] = np.maximum(best, 0)
                    wins.append((at, best > 0))
                p = 1 / (1 + np.exp(-np.clip(pooled @ net.output + net.bias, -30, 30)))
                error = (p - labels[d]) / len(batch)
                out_grad += error * pooled
                bias_grad += error
                for k, (width, win) in enumerate(zip(WIDTHS, wins)):
                    if win is None:
                        continue
                    at, active = win
                    g = (error * net.output[k * FILTERS:(k + 1) * FILTERS] * active).astype(np.float32)
                    for j in range(width):
                        grads[k][j] += x[at + j].T * g
                        touched.append(parts[ids[at + j]])
                        deltas.append(np.repeat((net.filters[k][j].T * g[:, None])[:, None], parts.shape[1], axis=1) / parts.shape[1])
            if touched:
                rows = np.concatenate([t.ravel() for t in touched])
                delta = np.concatenate([d.reshape(-1, DIMENSIONS) for d in deltas])
                unique, inverse = np.unique(rows, return_inverse=True)
                g = np.zeros((len(unique), DIMENSIONS), np.float32)
                np.add.at(g, inverse, delta)
                sums[0][unique] += g * g
                net.embeddings[unique] -= RATE * g / np.sqrt(sums[0][unique])
            for f, g, s in zip(net.filters, grads, sums[1]):
                step(f, g + 1e-4 * f, s)
            step(net.output, out_grad + 1e-4 * net.output, sums[2])
            bias_sum += bias_grad**2
            net.bias -= RATE * bias_grad / np.sqrt(bias_sum)
    return net


class Scorer:
    """Scores of texts; keeps the embeddings of known words up to a limit."""

    def __init__(self, net: Network):
        self.net = net
        self.joined = np.concatenate([f[j] for f in net.filters for j in range(len(f))], axis=1)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.known = np.zeros((0, DIMENSIONS), np.float32)

    def _rows(self, words: list[str]) -> np.ndarray:
        """Embeddings of the words in turn."""
        at = list(map(self.index.get, words))
        if None in at:
            if len(self.index) > _CACHED_WORDS:
                self._forget()
            new = list({w for w in words if w not in self.index})
            rows = self.net.embeddings[np.array([buckets_of(w) for w in new])].mean(axis=1)
            first = len(self.index)
            if first + len(new) > len(self.known):
                grown = np.zeros((2 * (first + len(new)), DIMENSIONS), np.float32)
                grown[:first] = self.known[:first]
                self.known = grown
            self.known[first: first + len(new)] = rows
            self.index.update(zip(new, range(first, first + len(new))))
            at = list(map(self.index.__getitem__, words))
        return self.known[at]

    def pooled(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(self.net.output), np.float32)
        for start in range(0, len(words), _CHUNK):
            chunk = words[start: start + _CHUNK + max(WIDTHS) - 1]
            rows = self._rows(chunk) @ self.joined
            column = 0
            for k, width in enumerate(WIDTHS):
                n = len(chunk) - width + 1
                if n > 0:
                    total = rows[:n, column: column + FILTERS]
                    for j in range(1, width):
                        total = total + rows[j: j + n, column + j * FILTERS: column + (j + 1) * FILTERS]
                    part = out[k * FILTERS:(k + 1) * FILTERS]
                    np.maximum(part, total.max(axis=0), out=part)
                column += width * FILTERS
        return out

    def logit(self, text: str | None) -> float:
        return float(self.pooled(words_of(text)) @ self.net.output + self.net.bias)


@dataclass
class ToxicityModel:
    """``slope`` and ``intercept`` calibrate the network's output; without a network every score is ``share``."""

    share: float = 0.0
    net: Network | None = None
    slope: float = 1.0
    intercept: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def probability(self, logits: Sequence[float]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(logits, float) + self.intercept, -30, 30)))

    def score(self, text: Column) -> Column:
        """Probability of label 1."""

        @F.pandas_udf("double")
        def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            scorer = Scorer(self.net) if self.net else None
            for texts in batches:
                yield pd.Series(self.probability([scorer.logit(t) for t in texts]) if scorer
                                else np.full(len(texts), self.share), dtype="float64")

        return scores(text)

    def threshold(self, lang: Column) -> Column:
        out = F.lit(THRESHOLD)
        for name, value in sorted(self.thresholds.items()):
            out = F.when(lang == name, value).otherwise(out)
        return out


def language_thresholds(score: np.ndarray, label: np.ndarray, lang: Sequence[str | None],
                        false_alarms: float = FALSE_ALARMS, least: int = 50) -> dict[str, float]:
    """The smallest threshold of at least 0.2 at which a language's clean texts stay below the share of false alarms."""
    out = {}
    for name in sorted({n for n in lang if n is not None}):
        clean = np.sort(score[[n == name and y == 0 for n, y in zip(lang, label)]])
        if len(clean) >= least:
            allowed = clean[len(clean) - 1 - int(false_alarms * len(clean))]
            out[name] = float(min(0.9, max(0.2, allowed + 1e-6)))
    return out


def fit_toxicity_texts(texts: Sequence[str], labels: Sequence[int], lang: Sequence[str | None], share: float) -> ToxicityModel:
    """Fit on texts in a random order; ``share`` is the share of label 1 among all labelled rows."""
    labels = np.asarray(labels, int)
    if min((labels == 0).sum(), (labels == 1).sum()) < 2:
        return ToxicityModel(share)
    rank = np.zeros(len(labels), int)
    for value in (0, 1):
        rank[labels == value] = np.arange((labels == value).sum())
    apart = rank % CALIBRATION_FOLDS == 1
    words = [words_of(t) for t in texts]
    net = train([w for w, a in zip(words, apart) if not a], labels[~apart])
    scorer = Scorer(net)
    logits, y = np.array([scorer.logit(t) for t, a in zip(texts, apart) if a]), labels[apart]
    spread = max(float(logits.std()), 1e-6)
    weight = len(y) * np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    slope, intercept = logistic(((logits - logits.mean()) / spread)[:, None], y, weight)
    model = ToxicityModel(share, net, float(slope / spread), float(intercept - slope * logits.mean() / spread))
    model.thresholds = language_thresholds(model.probability(logits), y, [n for n, a in zip(lang, apart) if a])
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> ToxicityModel:
    """Fit on at most ``2 * per_class`` labelled documents outside the held-out fold."""
    share = labels.filter(F.col("toxic").isin(0, 1) & ~held_out()).agg(F.avg("toxic")).first()[0]
    if share is None:
        return ToxicityModel()
    sample = labelled_sample(docs, labels, "toxic", per_class, max_chars, "lang").toPandas()
    sample = sample.sort_values("doc_id", key=lambda c: pd.util.hash_array(c.to_numpy()), kind="stable")
    return fit_toxicity_texts(sample["text"].tolist(), sample["label"].tolist(), sample["lang"].tolist(), share)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, lang_threshold, toxic.

    ``predicted`` compares the score with one threshold for all, ``toxic`` with that
    of the document's language.
    """
    scored = docs.select("doc_id", held_out().alias("held_out"), model.score(F.col("text")).alias("score"),
                         model.threshold(F.col("lang")).alias("lang_threshold"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
                         "lang_threshold", (F.col("score") >= F.col("lang_threshold")).alias("toxic"))
