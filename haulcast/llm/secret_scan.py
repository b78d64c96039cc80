"""Secret scanning: candidate strings, and a random forest that removes false positives.

Candidates are runs of letters, digits and ``_+/-`` with a digit in them and at least
eight characters, such runs without a digit from 22 characters on, and the whole value
assigned to a secret key name, of any characters and length: what stands between its
quotes, or else all up to the next white space. The forest judges its length, character classes and their changes,
how likely its letter pairs are in ordinary words, how much of it dictionary words
cover, the words beside it, and the path of its document. It is trained from all
labelled findings; a table of findings reviewed by people serves as well as the
ones that ``labelled_findings`` derives from unmistakable formats and key names.
Letter pairs and dictionary are counted over all words of all texts outside candidates,
and the values a tree may split at are exact quantiles of all labelled findings.

Edge cases: null and empty texts have no candidates; a null path is the empty path.
Ids may be null or repeated: each row is scanned. Very long runs are candidates like
any other, up to the end. With labels of one class only, or none, every score is the
share of label 1 (0 without labels). An empty table gives an empty result. Columns
besides doc_id, text and the path are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.session import materialise

#: Quantiles of a feature at which trees may split, and rows of a training partition.
QUANTILES, PARTITION_ROWS = 32, 5_000
TREES, DEPTH, SEED = 60, 8, 3
MIN_LENGTH = 8
#: Least length of a run without digits: 128 bits in base64.
MIN_LETTERS = 22
LEFT, RIGHT = 60, 20
THRESHOLD = 0.5
WORD_BUCKETS, PATH_BUCKETS = 32, 8

_CANDIDATE = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z_+/-]*+[0-9][A-Za-z0-9_+/-]*+={0,2}")
_LETTERS = re.compile(rf"(?<![A-Za-z0-9_+/-])(?=[_+/-]*+[A-Za-z])[A-Za-z_+/-]{{{MIN_LETTERS},}}+(?![0-9])={{0,2}}")
_WORD = re.compile(r"[A-Za-z]{2,}")
FINDINGS = "doc_id long, path string, start long, candidate string, before string, after string"
#: Words that a task counts before it hands them on.
WORDS_HELD = 100_000

# Key names and formats that leave no doubt, for deriving labels.
SECRET_KEYS = r"(?:password|passwd|pwd|token|secret|api_?key|access_?key|auth_?token|private_?key)"
SECRET_FORMATS = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35})$"
PLAIN_FORMATS = (r"^(?:[0-9+/_-]+|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[A-Za-z]+[-/_][A-Za-z0-9/_-]*[0-9]{1,4}"
                 r"|v?[0-9]+[-_/][A-Za-z0-9_/-]+)$")
# possessive, so that a long one takes no stack
PLAIN_WORDS = r"^(?:[A-Za-z]?[a-z]++|[A-Z]++)(?:[-/_](?:[A-Za-z]?[a-z]++|[A-Z]++))++$"
PLAIN_KEYS = r"(?:sha1|sha256|md5|commit|checksum|digest|revision|isbn|version)"


# after a key name: a value in quotes on one line, or all up to the next white space
_VALUE = re.compile(rf"""(?<![a-z0-9]){SECRET_KEYS}\s*+["']?\s*+[=:]{{1,2}}>?\s*+(?:"((?:[^"\\\n]|\\.)++)"|'((?:[^'\\\n]|\\.)++)'"""
                    r"""|["']?([^\s"']\S*+))""", re.IGNORECASE)


def candidates_in(text: str | None) -> Iterator[tuple[int, str, str, str]]:
    """(start, candidate, text before, text after) of each candidate; an assigned value and the runs within it count each."""
    text = text or ""
    spans = {m.span() for m in _CANDIDATE.finditer(text) if m.end() - m.start() >= MIN_LENGTH}
    spans.update(m.span() for m in _LETTERS.finditer(text))
    spans.update(m.span(m.lastindex) for m in _VALUE.finditer(text))
    for start, end in sorted(spans):
        yield start, text[start:end], text[max(0, start - LEFT): start], text[end: end + RIGHT]


def ordinary_words(text: str | None, spans: Sequence[tuple[int, int]]) -> Iterator[str]:
    """Words outside the spans (in the order of their starts) of a text."""
    text, at = text or "", 0
    for start, end in spans:
        yield from _WORD.findall(text, at, max(at, start))
        at = max(at, end)
    yield from _WORD.findall(text, at)


def scan_texts(docs: DataFrame, path: str) -> DataFrame:
    """One pass over all texts: rows of ``FINDINGS``, and rows with a lower-case ``word`` outside candidates and its count ``n``.

    A word has a row for each time that a task hands its counts on.
    """
    schema = f"{FINDINGS}, word string, n long"
    names = [c.split()[0] for c in schema.split(", ")]

    def frame(columns: dict[str, Sequence]) -> pd.DataFrame:
        none = [None] * max(map(len, columns.values()))
        table = pd.DataFrame({c: pd.Series(columns.get(c, none), dtype=object) for c in names})
        return table.astype({"doc_id": "Int64", "start": "Int64", "n": "Int64"})

    def found(rows: list[tuple]) -> pd.DataFrame:
        return frame({c: [r[k] for r in rows] for k, c in enumerate(names[:-2])})

    def counted(words: Counter[str]) -> pd.DataFrame:
        low = Counter()
        for w, n in words.items():
            low[w.lower()] += n
        return frame({"word": list(low), "n": list(low.values())})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Counter()
        for b in batches:
            rows = []
            for doc_id, where, text in zip(b["doc_id"].astype("Int64"), b["path"], b["text"]):
                spans = []
                for start, candidate, before, after in candidates_in(text):
                    rows.append((doc_id, where, start, candidate, before, after))
                    spans.append((start, start + len(candidate)))
                words.update(ordinary_words(text, spans))
                if len(rows) >= 10_000:
                    yield found(rows)
                    rows = []
                if len(words) >= WORDS_HELD:
                    yield counted(words)
                    words.clear()
            yield found(rows)
        yield counted(words)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"),
                       "text").mapInPandas(scan, schema)


def words_beside(findings: DataFrame) -> DataFrame:
    """Lower-case words in the text beside findings, with their counts ``n``."""
    words = F.regexp_extract_all(F.concat_ws(" ", "before", "after"), F.lit(_WORD.pattern), F.lit(0))
    return findings.select(F.explode(words).alias("word")).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))


def labelled_findings(findings: DataFrame) -> DataFrame:
    """Findings whose label their format or key name settles: label 1 for secrets, 0 for plain strings.

    A key name counts when it is assigned to the candidate by ``=`` or ``:``. Assigned
    values of letters only that are shorter than MIN_LENGTH, which may be placeholders,
    are left to the forest.
    """
    key = lambda names: F.lower("before").rlike(rf"(?:^|[^a-z0-9]){names}\s*[\"']?\s*[=:]?\s*[\"']?$")
    assigned = F.col("before").rlike(r"[=:]\s*[\"']?$")
    short_word = F.col("candidate").rlike(rf"^[A-Za-z]{{1,{MIN_LENGTH - 1}}}$")
    label = F.when(F.col("candidate").rlike(SECRET_FORMATS) | (key(SECRET_KEYS) & assigned & ~short_word), 1).when(
        F.col("candidate").rlike(PLAIN_FORMATS) | F.col("candidate").rlike(PLAIN_WORDS) | key(PLAIN_KEYS), 0)
    return findings.withColumn("label", label).filter("label is not null")


@dataclass(frozen=True)
class Language:
    """Log probabilities of letter pairs, and a dictionary of the most frequent words."""

    pairs: dict[str, float]
    unseen: float
    words: frozenset[str]

    @classmethod
    def of(cls, texts: Sequence[str], size: int = 5_000) -> "Language":
        words = Counter(w.lower() for t in texts for w in _WORD.findall(t))
        pairs = Counter()
        for w, n in words.items():
            for k in range(len(w) - 1):
                pairs[w[k:k + 2]] += n
        return cls._of(pairs, sorted((w for w in words if len(w) >= 4), key=lambda w: (-words[w], w))[:size])

    @classmethod
    def counted(cls, words: DataFrame, size: int = 5_000) -> "Language":
        """The same from a table of lower-case words and their counts ``n``; Spark adds up the pairs and ranks the words."""
        pair = F.explode(F.regexp_extract_all("word", F.lit("(?=([a-z]{2}))"), F.lit(1))).alias("pair")
        pairs = words.select(pair, "n").groupBy("pair").agg(F.sum("n").alias("n")).collect()
        known = words.filter(F.length("word") >= 4).orderBy(F.desc("n"), "word").limit(size).collect()
        return cls._of({r["pair"]: r["n"] for r in pairs}, [r["word"] for r in known])

    @classmethod
    def _of(cls, pairs: dict[str, int], known: Sequence[str]) -> "Language":
        total = sum(pairs.values()) + 676
        return cls({p: math.log((n + 1) / total) for p, n in pairs.items()}, math.log(1 / total), frozenset(known))

    def likelihood(self, text: str) -> float:
        """Mean log probability of the letter pairs of a string, 0 without any."""
        low = text.lower()
        found = [self.pairs.get(low[k:k + 2], self.unseen) for k in range(len(low) - 1) if low[k:k + 2].isalpha()]
        return sum(found) / len(found) if found else 0.0

    def coverage(self, text: str) -> float:
        """Share of a string that dictionary words cover, taking the longest word from the left."""
        low, at, covered = text.lower(), 0, 0
        while at < len(low):
            fit = next((n for n in range(min(16, len(low) - at), 3, -1) if low[at:at + n] in self.words), 0)
            covered += fit
            at += fit or 1
        return covered / max(1, len(low))


def _bucket(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % buckets


def features(candidate: str, before: str, after: str, path: str, language: Language) -> list[float]:
    n = len(candidate)
    kinds = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in candidate]
    counts = Counter(candidate)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    hexadecimal = sum(c in "0123456789abcdefABCDEF" for c in candidate) / n
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1)
    out = [float(n), *(kinds.count(k) / n for k in range(4)), entropy, hexadecimal, changes,
           language.likelihood(candidate), language.coverage(candidate),
           float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(before[-1:] in "\"'" and before != ""),
           float(after[:1] in "\"'" and after != "")]
    words = np.zeros(WORD_BUCKETS)
    for w in [*_WORD.findall(before)[-3:], *_WORD.findall(after)[:1]]:
        words[_bucket(w.lower(), WORD_BUCKETS)] = 1
    where = np.zeros(PATH_BUCKETS)
    for part in re.findall(r"[A-Za-z]+", path.lower()):
        where[_bucket(part, PATH_BUCKETS)] = 1
    return [*out, *words.tolist(), *where.tolist()]


def _features(language: Language) -> Column:
    """Features rounded to three decimals, so that few values differ."""

    @F.pandas_udf("array<double>")
    def compute(candidate: pd.Series, before: pd.Series, after: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([np.round(features(*x, language), 3) for x in zip(candidate, before, after, path)], dtype=object)

    return compute("candidate", "before", "after", "path")


def quantile_edges(table: DataFrame, width: int) -> list[list[float]]:
    """Exact quantiles of each entry of the arrays ``_values`` over all rows, without repeats."""
    at = [k / QUANTILES for k in range(QUANTILES + 1)]
    return [sorted(set(q)) for q in table.agg(*(F.percentile(F.col("_values")[k], at).alias(f"q{k}") for k in range(width))).first()]


def _codes(edges: list[list[float]]) -> Column:
    """Each value's place among its edges; below, at and above an edge differ."""

    @F.pandas_udf("array<double>")
    def compute(values: pd.Series) -> pd.Series:
        if values.empty:
            return pd.Series([], dtype=object)
        x = np.stack(values.to_list())
        codes = np.column_stack([np.searchsorted(e, x[:, k], "left") + np.searchsorted(e, x[:, k], "right")
                                 for k, e in enumerate(edges)])
        return pd.Series(list(codes.astype(float)), dtype=object)

    return compute("_values")


@dataclass
class SecretModel:
    """A forest over coded features; without one every score is ``share``."""

    share: float = 0.0
    language: Language | None = None
    edges: list[list[float]] | None = None
    forest: RandomForestClassificationModel | None = None

    def score(self, findings: DataFrame) -> DataFrame:
        """Adds ``score``, the probability of a secret."""
        if self.forest is None:
            return findings.withColumn("score", F.lit(float(self.share)))
        coded = findings.withColumn("_values", _features(self.language)).withColumn("_features", array_to_vector(_codes(self.edges)))
        judged = self.forest.transform(coded).withColumn("score", vector_to_array("_probability")[1])
        return judged.drop("_values", "_features", "_raw", "_probability", "_prediction")


def fit_secrets(labelled: DataFrame, words: DataFrame | None = None, trees: int = TREES, depth: int = DEPTH) -> SecretModel:
    """Train on all labelled findings (columns of ``FINDINGS`` and label).

    ``words``: ordinary words and their counts ``n``; without them those beside the labelled findings.
    """
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = counts.get(0, 0) + counts.get(1, 0)
    if not counts.get(0) or not counts.get(1):
        return SecretModel(counts.get(1, 0) / total if total else 0.0)
    language = Language.counted(materialise(words_beside(labelled) if words is None else words, "words"))
    known = labelled.filter(F.col("label").isin(0, 1)).select("doc_id", "start", F.col("label").cast("double").alias("label"),
                                                              _features(language).alias("_values"))
    table = materialise(known, "features")
    edges = quantile_edges(table, len(features("x", "", "", "", language)))
    # bags depend on the order of the rows: the same one in each run
    key = ["doc_id", "start", "label", "_values"]
    ordered = table.repartition(-(-total // PARTITION_ROWS), *key).sortWithinPartitions(*key)
    # Spark looks for split values in max(10,000, maxBins ** 2) rows: so many bins that these are all; codes fill few of them
    bins = max(2 * QUANTILES + 3, math.isqrt(total) + 1)
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", probabilityCol="_probability",
                                    rawPredictionCol="_raw", predictionCol="_prediction", numTrees=trees, maxDepth=depth,
                                    maxBins=bins, subsamplingRate=0.8, seed=SEED)
    return SecretModel(counts[1] / total, language, edges,
                       forest.fit(ordered.select(array_to_vector(_codes(edges)).alias("_features"), "label")))


def redacted(candidate: Column) -> Column:
    """The first four characters, at most half of them, and the number of those left out."""
    shown = F.least(F.lit(4), F.floor(F.length(candidate) / 2).cast("int"))
    return F.concat(F.substring(candidate, F.lit(1), shown), F.lit("...+"), (F.length(candidate) - shown).cast("string"))


def scan(docs: DataFrame, path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate of every text: doc_id, start, length, redacted, score, secret.

    Findings are written once; labels are derived from them and the forest judges
    all of them, the labelled ones as well.
    """
    scanned = materialise(scan_texts(docs, path), "candidates")
    findings = scanned.filter("candidate is not null").drop("word", "n")
    words = scanned.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    scored = fit_secrets(labelled_findings(findings), words).score(findings)
    return scored.select("doc_id", "start", F.length("candidate").cast("long").alias("length"),
                         redacted(F.col("candidate")).alias("redacted"), "score", (F.col("score") >= threshold).alias("secret"))
