"""Quality scores by co-training of a content view and a metadata view.

The content view sees measures of the text (shares of character classes, word
lengths, repetition); the metadata view sees what is recorded about the page:
source, language and size.  Each view is a logistic model over binned measures.
Both are fitted on a bounded sample of labelled documents.  In every round both
then judge all other documents, in Spark, and each hands its confident
judgements to the other as additional training labels: a step of the training
is one pass over the binned measures that returns the summed slopes of both
models, a few numbers for each bin.  At the end both are calibrated on labelled
documents that neither was trained on, and one more logistic model combines the
two calibrated scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsieve.llm.arrays import ragged, text_slices, utf8, word_hashes
from credsieve.session import keep

SAMPLE = 20_000
#: Sources and languages with a code of their own: so many of the most frequent ones, and all of the sample.
VALUES = 20_000
ROUNDS = 3
#: Passes over the judged documents in each round.
STEPS = 6
BINS = 16
CONFIDENT = 0.95
#: Codes of metadata: of null, of a value that the fitted rows do not hold, and of the first that they do.
NULL, UNSEEN, KNOWN = 0, 1, 2
_MEASURES = 14
_UNIT = 1 << 24
_META = ("source", "lang", "size")


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.int64)
    kind[ord("a") : ord("z") + 1] = 1
    kind[ord("A") : ord("Z") + 1] = 2
    kind[ord("0") : ord("9") + 1] = 3
    kind[[0x20, 0x09]] = 4
    kind[[0x0A, 0x0D]] = 5
    kind[list(b".,;:'\"()-")] = 6
    kind[list(b"!?")] = 7
    kind[[c for c in range(0x21, 0x7F) if kind[c] == 0]] = 8
    return kind


_CLASS = _classes()


def measures(column: pa.Array) -> np.ndarray:
    """One row of _MEASURES numbers per text; all zero for a null or empty text."""
    flat, at = utf8(column)
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    kinds = np.bincount(owner * 9 + _CLASS[flat], minlength=n * 9).reshape(n, 9).astype(float)
    size = np.maximum(np.diff(at), 1)
    words, where = word_hashes(flat, at)
    count = np.diff(where)
    some = np.maximum(count, 1)
    of = np.repeat(np.arange(n), count)
    key = (words >> np.uint64(16)) | (of.astype(np.uint64) << np.uint64(48))
    key.sort()
    fresh = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    distinct = np.bincount((key[fresh] >> np.uint64(48)).astype(np.int64), minlength=n)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    again_share = np.bincount(of[again], minlength=n) / some
    letters = np.maximum(kinds[:, 0] + kinds[:, 1] + kinds[:, 2], 1)
    lengths = (size - kinds[:, 4] - kinds[:, 5]) / some
    return np.column_stack([
        np.log1p(count), kinds[:, 0] / size, kinds[:, 2] / letters, kinds[:, 3] / size, kinds[:, 4] / size, kinds[:, 5] / size,
        kinds[:, 6] / some, kinds[:, 7] / some, kinds[:, 8] / some, kinds[:, 8] / size, lengths, distinct / some,
        again_share, np.log1p(distinct),
    ]) * (count > 0)[:, None]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(bins: np.ndarray, levels: int, y: np.ndarray, ridge: float = 3e-4, steps: int = 300) -> np.ndarray:
    """Weights of a logistic model over one-hot bins (rows of codes below `levels`), the last one the constant."""
    rows, columns = bins.shape
    place = bins + np.arange(columns) * levels
    value = np.zeros(columns * levels + 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    value[-1] = np.log(share / (1 - share))
    mean, square = np.zeros_like(value), np.zeros_like(value)
    for step in range(1, steps + 1):
        miss = logistic(value[place].sum(axis=1) + value[-1]) - y
        slope = np.bincount(place.ravel(), weights=np.repeat(miss, columns), minlength=len(value)) / rows + ridge * value
        slope[-1] = miss.mean()
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        value = value - 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return value


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression on a few numbers by Newton's method; constant last."""
    x = np.column_stack([x, np.ones(len(x))])
    value = np.zeros(x.shape[1])
    for _ in range(30):
        p = logistic(x @ value)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(value))
        value = value - np.linalg.solve(hessian, x.T @ (p - y) + ridge * value)
    return value


@dataclass
class View:
    """A logistic model over binned numbers, with its calibration."""

    edges: np.ndarray  # (numbers, levels - 1)
    weights: np.ndarray
    calibration: np.ndarray

    def of_bins(self, bins: np.ndarray) -> np.ndarray:
        return self.weights[_places(bins, self.edges)].sum(axis=1) + self.weights[-1]

    def raw(self, numbers: np.ndarray) -> np.ndarray:
        return self.of_bins(_binned(numbers, self.edges))

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(raw * self.calibration[0] + self.calibration[1], -20, 20)

    def logit(self, numbers: np.ndarray) -> np.ndarray:
        return self.calibrated(self.raw(numbers))


@dataclass
class Model:
    content: View
    meta: View
    combined: np.ndarray
    # the sources and languages of the fitted rows, in the order of their codes
    sources: pa.Array = field(default_factory=lambda: pa.array([], pa.string()))
    languages: pa.Array = field(default_factory=lambda: pa.array([], pa.string()))

    def score(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined, content and metadata probabilities of good quality."""
        a, b = self.content.logit(content), self.meta.logit(meta)
        return logistic(np.column_stack([a, b, np.ones(len(a))]) @ self.combined), logistic(a), logistic(b)


def _places(bins: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the weights of bins are."""
    return bins + np.arange(bins.shape[1]) * (edges.shape[1] + 1)


def _binned(numbers: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, numbers[:, j], side="right") for j, e in enumerate(edges)])


def _quantiles(numbers: np.ndarray) -> np.ndarray:
    return np.quantile(numbers, np.arange(1, BINS) / BINS, axis=0).T


def meta_columns() -> list[Column]:
    """The metadata: source and language as they are, and the recorded size as a number."""
    size = F.log1p(F.greatest(F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0)))
    return [*(F.col(c).cast("string").alias(c) for c in ("source", "lang")), size.alias("size")]


def _values(column: pa.ChunkedArray) -> pa.Array:
    """The distinct values of a column in order, without null."""
    found = pc.unique(column).drop_null()
    return found.take(pc.sort_indices(found))


def _codes(column: pa.Array | pa.ChunkedArray, values: pa.Array) -> np.ndarray:
    at = pc.index_in(column, value_set=values.cast(column.type), skip_nulls=True)
    known = pc.add(pc.fill_null(at, UNSEEN - KNOWN), KNOWN)
    return pc.if_else(pc.is_null(column), NULL, known).to_numpy(zero_copy_only=False).astype(float)


def _meta_numbers(batch: pa.RecordBatch | pa.Table, sources: pa.Array, languages: pa.Array) -> np.ndarray:
    size = batch.column("size").to_numpy(zero_copy_only=False)
    return np.column_stack([_codes(batch.column("source"), sources), _codes(batch.column("lang"), languages), size])


Views = tuple[np.ndarray, np.ndarray] | list[np.ndarray]
Teach = Callable[[list[View], list[View]], "list[Slopes]"]


@dataclass
class Slopes:
    """Sums over the rows that one view is taught: slopes and rows by weight, loss, and the number of rows.

    Slopes and losses are whole numbers of 1 / _UNIT, so that sums do not depend on their order.
    """

    slope: np.ndarray
    rows: np.ndarray
    loss: int
    n: int

    def __add__(self, other: Slopes) -> Slopes:
        return Slopes(self.slope + other.slope, self.rows + other.rows, self.loss + other.loss, self.n + other.n)


def slopes(bins: np.ndarray, y: np.ndarray, view: View) -> Slopes:
    place, size = _places(bins, view.edges), len(view.weights)
    raw = view.of_bins(bins)
    miss = np.rint((logistic(raw) - y) * _UNIT)
    loss = np.rint(np.logaddexp(0, np.where(y > 0.5, -raw, raw)) * _UNIT).sum()
    slope = np.bincount(place.ravel(), weights=np.repeat(miss, bins.shape[1]), minlength=size)
    slope[-1] = miss.sum()
    rows = np.bincount(place.ravel(), minlength=size)
    rows[-1] = len(bins)
    return Slopes(slope.astype(np.int64), rows.astype(np.int64), int(loss), len(bins))


def taught(bins: Views, givers: list[View], views: list[View]) -> list[Slopes]:
    """Slopes of each view over the rows that the other one, as in `givers`, is confident about."""
    out = []
    for which, view in enumerate(views):
        p = logistic(givers[1 - which].calibrated(givers[1 - which].of_bins(bins[1 - which])))
        sure = (p >= CONFIDENT) | (p <= 1 - CONFIDENT)
        out.append(slopes(bins[which][sure], (p[sure] > 0.5).astype(float), view))
    return out


class Descent:
    """Minimises the mean loss of the labelled and that of the taught rows, in equal parts, from one pass to the next.

    A step divides the slopes by a bound of the curvature, which never climbs,
    and is then lengthened by what the steps before have shown (limited-memory
    quasi-Newton); if that climbed, the plain step from the best point is taken.
    """

    def __init__(self, view: View, bins: np.ndarray, y: np.ndarray, ridge: float):
        self.view, self.bins, self.y, self.ridge = view, bins, y, ridge
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.best: tuple[float, np.ndarray, np.ndarray, np.ndarray] | None = None
        self.last: tuple[np.ndarray, np.ndarray] | None = None

    def step(self, other: Slopes) -> None:
        if not other.n:
            return
        own = slopes(self.bins, self.y, self.view)
        weights = self.view.weights
        held = np.append(np.full(len(weights) - 1, self.ridge), 0.0)
        slope = (own.slope / own.n + other.slope / other.n) / (2 * _UNIT) + held * weights
        loss = (own.loss / own.n + other.loss / other.n) / (2 * _UNIT) + (held * weights**2).sum() / 2
        bound = (own.rows / own.n + other.rows / other.n) / 8 * (self.bins.shape[1] + 1) + held + 1e-9
        if self.best is not None and loss > self.best[0]:
            self.pairs, self.last = [], None
            _, weights, slope, bound = self.best
        else:
            if self.last is not None:
                moved, turned = weights - self.last[0], slope - self.last[1]
                if moved @ turned > 1e-12:
                    self.pairs.append((moved, turned))
            self.best, self.last = (loss, weights, slope, bound), (weights, slope)
        way, shares = slope.copy(), []
        for moved, turned in reversed(self.pairs):
            shares.append((moved @ way) / (moved @ turned))
            way -= shares[-1] * turned
        way /= bound
        for (moved, turned), share in zip(self.pairs, reversed(shares), strict=True):
            way += moved * (share - (turned @ way) / (moved @ turned))
        self.view = View(self.view.edges, weights - way, self.view.calibration)

    def done(self) -> View:
        """The best point that was looked at; a round ends with such a look."""
        return self.view if self.best is None else View(self.view.edges, self.best[1], self.view.calibration)


def _edges(content: np.ndarray, meta: np.ndarray, codes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the bins of both views; metadata codes below the given numbers have a bin each."""
    size = _quantiles(meta[:, 2:])
    # at least bins for null and unseen values, and as many as the size has
    last = np.maximum(np.array(codes) - 1, UNSEEN)
    wide = np.full((3, max(*last, size.shape[1])), np.inf)
    for column in (0, 1):
        wide[column, : last[column]] = np.arange(1, last[column] + 1)
    wide[2, : size.shape[1]] = size[0]
    return _quantiles(content), wide


def co_train(
    bins: Views, edges: tuple[np.ndarray, np.ndarray], y: np.ndarray, held: np.ndarray, teach: Teach, rounds: int = ROUNDS
) -> tuple[Model, list[tuple[int, int]]]:
    """Fit on labelled rows (`y` is 0 or 1); `held` ones only calibrate.

    `teach(givers, views)` gives the slopes of both views over all other rows,
    as `taught` does.  Also returns how many rows the content and the metadata
    view taught the other in each round.  They are judged afresh every round, by
    views calibrated on the held rows, and only confident judgements count.
    """
    train, keepers = np.flatnonzero(~held), np.flatnonzero(held)
    if not len(keepers):
        keepers = train
    ridges = (3e-4, 3e-3)

    def calibrated(which: int, view: View) -> View:
        raw = view.of_bins(bins[which][keepers])
        return View(view.edges, view.weights, fit_linear(raw[:, None], y[keepers].astype(float)))

    def alone(which: int) -> View:
        weights = fit_logistic(bins[which][train], edges[which].shape[1] + 1, y[train].astype(float), ridges[which])
        return View(edges[which], weights, np.array([1.0, 0.0]))

    views = [calibrated(which, alone(which)) for which in (0, 1)]
    history = []
    for _ in range(rounds):
        climbers = [Descent(v, bins[w][train], y[train].astype(float), ridges[w]) for w, v in enumerate(views)]
        for _ in range(STEPS):
            found = teach(views, [c.view for c in climbers])
            for climber, other in zip(climbers, found, strict=True):
                climber.step(other)
        history.append((found[1].n, found[0].n))
        views = [calibrated(which, climber.done()) for which, climber in enumerate(climbers)]
    logits = np.column_stack([v.calibrated(v.of_bins(b[keepers])) for v, b in zip(views, bins, strict=True)])
    return Model(*views, fit_linear(logits, y[keepers].astype(float))), history


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start, stop in text_slices(whole, "text", 1 << 16):
            batch = whole.slice(start, stop - start)
            found = measures(batch.column("text"))
            lists = ragged(found.ravel(), np.arange(len(found) + 1) * _MEASURES)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "label", *_META)), lists], ["doc_id", "label", *_META, "content"]
            )


def _bins_of(batches: Iterator[pa.RecordBatch], edges: tuple, sources: pa.Array, languages: pa.Array) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers = np.array(batch.column("content").flatten()).reshape(-1, _MEASURES)
        both = [_binned(numbers, edges[0]), _binned(_meta_numbers(batch, sources, languages), edges[1])]
        lists = [ragged(b.ravel().astype(np.int32), np.arange(len(b) + 1) * b.shape[1]) for b in both]
        yield pa.RecordBatch.from_arrays(lists, ["content", "meta"])


def _taught(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """(view, place, slope, n) of a part of the rows; place -1 has the loss and the number of rows."""
    givers, views = sent.value
    total: list[Slopes] | None = None
    for batch in batches:
        bins = [np.array(batch.column(c).flatten()).reshape(batch.num_rows, -1) for c in ("content", "meta")]
        found = taught(bins, givers, views)
        total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
    for which, part in enumerate(total or []):
        place = np.flatnonzero(part.rows)
        columns = [np.append(place, -1), np.append(part.slope[place], part.loss), np.append(part.rows[place], part.n)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place) + 1, which)), *map(pa.array, columns)], ["view", "place", "slope", "n"])


def _teacher(binned: DataFrame) -> Teach:
    """Slopes over all rows of a table of bins; what comes back are sums for each weight."""

    def teach(givers: list[View], views: list[View]) -> list[Slopes]:
        sent = binned.sparkSession.sparkContext.broadcast((givers, views))
        rows = binned.mapInArrow(partial(_taught, sent=sent), "view bigint, place bigint, slope bigint, n bigint")
        sums = rows.groupBy("view", "place").agg(F.sum("slope").alias("slope"), F.sum("n").alias("n")).toArrow()
        which, place, slope, n = (sums.column(c).to_numpy() for c in ("view", "place", "slope", "n"))
        out = []
        for i, view in enumerate(views):
            part = Slopes(np.zeros(len(view.weights), np.int64), np.zeros(len(view.weights), np.int64), 0, 0)
            own, whole = (which == i) & (place >= 0), np.flatnonzero((which == i) & (place < 0))
            part.slope[place[own]], part.rows[place[own]] = slope[own], n[own]
            if len(whole):
                part.loss, part.n = int(slope[whole[0]]), int(n[whole[0]])
            out.append(part)
        sent.unpersist()
        return out

    return teach


def _frequent(rows: DataFrame, column: str, sampled: pa.ChunkedArray, most: int) -> pa.Array:
    """The values that get a code: those of the sample and the most frequent ones of all rows, in order."""
    counted = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    best = counted.orderBy(F.desc("n"), column).limit(most).select(column).toArrow().column(column)
    return _values(pa.chunked_array([*sampled.cast(pa.string()).chunks, *best.cast(pa.string()).chunks], pa.string()))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, values: int = VALUES) -> Model | None:
    """Fit on at most `sample` labelled documents, dealt by a hash of doc_id, and on all others without their labels.

    `sample` is the documented bound of the labelled rows, which come back as
    numbers, source and language and also set the borders of the bins.  All
    other documents are measured and binned once and judged where they lie.
    `values` bounds the model: so many of the most frequent sources and
    languages have a code of their own, besides those of the sample; rarer ones
    share a code, and what all of them teach.
    Several labels of a document count as good if one does.  None if there is
    no label of one of the two kinds, as then nothing can be told apart.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *meta_columns())
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    drawn = F.broadcast(keep(picked, "quality"))  # at most `sample` rows of 12 bytes
    rows = own.join(drawn, "doc_id", "left").select("doc_id", "label", "text", *_META)
    schema = "doc_id bigint, label int, source string, lang string, size double, content array<double>"
    measured = keep(rows.mapInArrow(_measured, schema), "measures")
    found = measured.where("label is not null").toArrow()
    label = found.column("label").to_numpy()
    if not (label == 0).any() or not (label == 1).any():
        return None
    found = found.sort_by([(c, "ascending") for c in ("doc_id", "label", *_META)])
    label = found.column("label").to_numpy()
    content = np.array(found.column("content").to_pylist(), float).reshape(-1, _MEASURES)
    sources, languages = (_frequent(measured, c, found.column(c), values) for c in ("source", "lang"))
    meta = _meta_numbers(found, sources, languages)
    edges = _edges(content, meta, (KNOWN + len(sources), KNOWN + len(languages)))
    bins = (_binned(content, edges[0]), _binned(meta, edges[1]))
    others = measured.where("label is null")
    binned = keep(
        others.mapInArrow(partial(_bins_of, edges=edges, sources=sources, languages=languages), "content array<int>, meta array<int>"), "bins"
    )
    model = co_train(bins, edges, label, np.arange(len(label)) % 4 == 3, _teacher(binned))[0]
    model.sources, model.languages = sources, languages
    return model


def _scored(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[tuple[pa.RecordBatch, tuple]]:
    for whole in batches:
        for start, stop in text_slices(whole, "text", 1 << 16):
            batch = whole.slice(start, stop - start)
            if model is None:
                yield batch, (np.full(batch.num_rows, 0.5),) * 3  # nothing learned: every row stays
            else:
                yield batch, model.score(measures(batch.column("text")), _meta_numbers(batch, model.sources, model.languages))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, quality_score, content_score, meta_score, kept) for every row of `docs`.

    Reads doc_id, text, source, lang and n_chars; null metadata has its own
    code, as have values that no fitted row holds, a null text the measures of
    an empty one.  A row is kept from a score
    of 0.5 on; without a model all scores are 0.5.  Rows are judged one by one.
    """
    names = ["quality_score", "content_score", "meta_score"]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores in _scored(batches, model):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, scores), pa.array(scores[0] >= 0.5)], ["doc_id", *names, "kept"]
            )

    schema = docs.select("doc_id").schema
    for name in names:
        schema = schema.add(name, "double")
    return docs.select("doc_id", "text", *meta_columns()).mapInArrow(judged, schema.add("kept", "boolean"))


def without_poor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, with the columns they came with."""
    model = fit(docs, labels)
    names = [f"c{i}" for i in range(len(docs.columns))]
    carried = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)), *meta_columns())
    text = names[docs.columns.index("text")]

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = pa.RecordBatch.from_arrays([batch.column(text), *(batch.column(c) for c in _META)], ["text", *_META])
            scores = [s[0] for _, s in _scored(iter([seen]), model)]
            picked = batch.filter(pa.array(np.concatenate(scores) >= 0.5 if scores else np.zeros(0, bool)))
            yield pa.RecordBatch.from_arrays([picked.column(n) for n in names], docs_names)

    docs_names = docs.columns
    return carried.mapInArrow(good, docs.schema)
