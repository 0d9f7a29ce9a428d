"""Toxicity grades by cumulative-link (proportional odds) ordinal regression.

A text's features are its words and their beginnings (four to six letters), so
that a stem with many endings counts as one thing.  Features that stand out in
texts labelled toxic (by a z-score of their log odds, and in LEAST_ODDS times as
many toxic as clean texts) are selected over the labelled sample; one weight vector
over them, shared by all ordered thresholds, gives the probabilities

    P(grade <= k) = logistic(threshold[k] - weights . features)

of the grades 0 (clean), 1 (toxic) and 2 (severe: a labelled toxic text with at
least as many marked words as the median toxic one).  The expected grade is the
severity; a text is toxic if grades above 0 are likelier than not.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.arrays import text_slices
from credsieve.session import keep

SAMPLE = 20_000
FEATURES = 2048
LEAST_TEXTS = 5
LEAST_Z = 4.0
LEAST_ODDS = 4
PREFIXES = (4, 5, 6)
GRADES = 3
VIEWS = 3
_WORD = re.compile(r"\w+")
_CACHED_WORDS = 100_000
_HELD = 150_000


def word_features(word: str) -> list[str]:
    """The word itself, and its beginnings marked with a trailing dash."""
    return [word, *(f"{word[:k]}-" for k in PREFIXES if len(word) >= k)]


class Marked:
    """Looks up the selected features of a text; remembers words, within a bound."""

    def __init__(self, index: dict[str, int]):
        self.index = index
        self.seen: dict[str, tuple[int, ...]] = {}

    def words(self, text: str) -> list[tuple[int, ...]]:
        """The features of every word that has some, in order, one entry per occurrence."""
        if len(self.seen) > _CACHED_WORDS:
            self.seen.clear()
        found, words = [], Counter(_WORD.findall(text.lower()))
        for word, times in words.items():
            hit = self.seen.get(word)
            if hit is None:
                hit = self.seen[word] = tuple(self.index[f] for f in word_features(word) if f in self.index)
            if hit:
                found.extend([hit] * times)
        return found


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, eta: np.ndarray) -> np.ndarray:
        return _grade_probabilities(eta, self.thresholds)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _grade_probabilities(eta: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    below = np.column_stack([np.zeros(len(eta)), _logistic(thresholds[None, :] - eta[:, None]), np.ones(len(eta))])
    return np.diff(below, axis=1)


def fit_ordinal(
    row: np.ndarray, column: np.ndarray, grades: np.ndarray, width: int, ridge: float = 1e-4, steps: int = 500
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds for binary features, given as the places (row, column) of the ones.

    Minimises the mean negative log likelihood plus a ridge on the weights, by
    Adam with full batches.  Thresholds stay ordered because their gaps are
    exponentials.
    """
    n, levels = len(grades), int(max(GRADES, grades.max(initial=0) + 1))
    share = np.clip(np.cumsum(np.bincount(grades, minlength=levels) + 0.5)[:-1] / (n + 0.5 * levels), 1e-6, 1 - 1e-6)
    start = np.log(share / (1 - share))
    value = np.concatenate([np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    mean, square = np.zeros_like(value), np.zeros_like(value)
    for step in range(1, steps + 1):
        weights, gaps = value[:width], np.exp(value[width + 1 :])
        thresholds = np.cumsum(np.concatenate([value[width : width + 1], gaps]))
        eta = np.bincount(row, weights=weights[column], minlength=n)
        below = _logistic(thresholds[None, :] - eta[:, None])
        slope = np.column_stack([np.zeros(n), below * (1 - below), np.zeros(n)])
        edge = np.column_stack([np.zeros(n), below, np.ones(n)])
        at = np.arange(n)
        p = np.maximum(edge[at, grades + 1] - edge[at, grades], 1e-12)
        d_eta = (slope[at, grades + 1] - slope[at, grades]) / p
        d_threshold = np.zeros(levels + 1)
        np.add.at(d_threshold, grades + 1, -slope[at, grades + 1] / p)
        np.add.at(d_threshold, grades, slope[at, grades] / p)
        d_threshold = d_threshold[1:-1] / n
        d_gap = np.cumsum(d_threshold[::-1])[::-1]
        gradient = np.concatenate([
            np.bincount(column, weights=d_eta[row], minlength=width) / n + ridge * weights, d_gap[:1], d_gap[1:] * gaps
        ])
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        value = value - 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return value[:width], np.cumsum(np.concatenate([value[width : width + 1], np.exp(value[width + 1 :])]))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start, stop in text_slices(whole, "text"):
            yield whole.slice(start, stop - start)


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flushed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int32()),
             pa.array(list(held.values()), pa.int64())], ["feature", "toxic", "n"]
        )
        held.clear()
        return out

    for batch in _slices(batches):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            features = {f for w in set(_WORD.findall((text or "").lower())) for f in word_features(w)}
            held.update((f, toxic) for f in features)
            if len(held) > _HELD:
                yield flushed()
    yield flushed()


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """(doc_id, text, toxic) of at most `size` labelled documents, dealt by a hash of doc_id.

    Several labels of a document count as toxic if one does.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # `size` rows of 12 bytes


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """Fit on at most `sample` labelled documents (a documented bound; selection and fit see the same rows).

    Without a toxic or without a clean label there are no features, and nothing
    is toxic.
    """
    rows = keep(labelled_sample(docs, labels, sample), "toxicity")
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    if not clean or not toxic:
        return Model({}, np.zeros(0), np.array([20.0, 25.0]))
    count = lambda label: F.coalesce(F.sum(F.when(F.col("toxic") == label, F.col("n"))), F.lit(0))
    counted = rows.select("text", "toxic").mapInArrow(_feature_counts, "feature string, toxic int, n bigint")
    by_feature = counted.groupBy("feature").agg(count(1).alias("t"), count(0).alias("c")).where(F.col("t") >= LEAST_TEXTS)
    odds = lambda x, n: F.log((F.col(x) + 0.5) / (F.lit(n + 0.5) - F.col(x)))
    spread = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    z = (odds("t", toxic) - odds("c", clean)) / spread
    chosen = by_feature.withColumn("z", z).where((F.col("z") >= LEAST_Z) & (F.col("t") > LEAST_ODDS * F.col("c"))).orderBy(F.col("z").desc(), "feature").limit(features)
    index = {r["feature"]: i for i, r in enumerate(chosen.select("feature").collect())}

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Marked(index)
        kind = pa.list_(pa.struct([("times", pa.int32()), ("features", pa.list_(pa.int32()))]))
        for batch in _slices(batches):
            hits = [Counter(look.words(t or "")) for t in batch.column("text").to_pylist()]
            words = [[{"times": n, "features": f} for f, n in sorted(h.items())] for h in hits]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(words, kind)], ["toxic", "words"])

    drawn = rows.select("text", "toxic").mapInArrow(
        marked, "toxic int, words array<struct<times:int,features:array<int>>>"
    ).toArrow()  # at most `sample` rows with some numbers each
    texts = sorted(zip(drawn.column("toxic").to_pylist(), drawn.column("words").to_pylist(), strict=True), key=str)
    row, column, grades = _examples(texts)
    return Model(index, *fit_ordinal(row, column, grades, len(index)))


def _examples(texts: list[tuple[int, list[dict]]], seed: int = 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (row, column) of the ones and grades of the training examples.

    A toxic text comes with VIEWS further examples that hold a random half of
    its marked words, so that each word has to tell by itself, and not only
    together with others that are always near it.
    """
    random = np.random.default_rng(seed)
    marks = [sum(w["times"] for w in words) for toxic, words in texts if toxic]
    severe = max(1, float(np.median(marks)))
    examples: list[tuple[int, list[dict]]] = []
    for toxic, words in texts:
        examples.append((toxic, words))
        if toxic and len(words) > 1:
            for _ in range(VIEWS):
                some = random.random(len(words)) < 0.5
                some[random.integers(len(words))] = True
                examples.append((toxic, [w for w, taken in zip(words, some, strict=True) if taken]))
    active = [sorted({i for w in words for i in w["features"]}) for _, words in examples]
    grades = [1 + (sum(w["times"] for w in words) >= severe) if toxic else 0 for toxic, words in examples]
    row = np.repeat(np.arange(len(active)), [len(a) for a in active])
    return row, np.array([i for a in active for i in a], np.int64), np.array(grades, np.int64)


def _probable(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches with the probabilities of the grades of their rows."""
    look = Marked(model.index)
    for batch in _slices(batches):
        active = [{i for word in look.words(t or "") for i in word} for t in batch.column("text").to_pylist()]
        yield batch, model.probabilities(np.array([sum(model.weights[i] for i in a) for a in active], float))


def grade(docs: DataFrame, model: Model, returned: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns named in `returned`) with severity (0 to 2) and toxic appended.

    Reads the column text only; a null or empty text has no features.  Columns
    of `docs` named severity or toxic are replaced.  Rows are judged one by
    one, so repeated rows get equal answers; an empty table gives no rows.
    """
    kept = [c for c in returned or docs.columns if c.lower() not in ("severity", "toxic")]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p in _probable(batches, model):
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(p @ np.arange(p.shape[1])), pa.array(p[:, 0] < 0.5)],
                [*kept, "severity", "toxic"],
            )

    schema = docs.select(*kept).schema.add("severity", "double").add("toxic", "boolean")
    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(judged, schema)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not toxic, with the columns they came with, whatever their names."""
    model = fit(docs, labels)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p in _probable(batches, model):
            yield batch.filter(pa.array(p[:, 0] >= 0.5))

    return docs.mapInArrow(clean, docs.schema)
