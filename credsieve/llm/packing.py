"""Packing of tokenised documents into sequences by non-negative least squares.

Every document is cut into whole windows and one rest.  Combinations of one,
two or three rest lengths that fill a window are enumerated; how often each is
used comes from a non-negative least squares fit of the combinations to the
histogram of rest lengths, rounded down.  The lengths left over are packed
greedily, longest first.  All of that works on the histogram, which has as many
bins as a window has tokens; the pieces themselves are numbered per length in
parallel and look their places up in the plan.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credsieve.llm.arrays import text_slices, utf8
from credsieve.session import keep

WINDOW = 2048
END = 1
_CACHED_WORDS = 400_000
_CACHED_IDS = 4_000_000
_SLICE = 4 << 20
_TOGETHER = 4096


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER[ord("\n")] = ord(" ")
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = 1
_KIND[list(b"!\"#$%&()*+,-./:;<=>?@[]^_`{|}~")] = 2


def _parts(flat: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct parts of all texts between blanks, their numbers in order, and how many each text has.

    Line feeds count as blanks.  Letters A-Z become small and a blank is put
    between a letter and a sign: the tokenizer does the one and cuts at the
    other anyway, and equal parts become more frequent.  Only what could be a
    special token is left as it is.
    """
    plain = flat.tobytes().find(b"<|") < 0
    text = _LOWER[flat] if plain else np.where(flat == ord("\n"), np.uint8(ord(" ")), flat)
    cuts = np.zeros(0, np.int64)
    if plain and len(flat):
        kind = _KIND[flat]
        border = kind[:-1] + kind[1:] == 3
        border[at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(flat))] - 1] = False
        cuts = np.flatnonzero(border) + 1
    blanks = np.searchsorted(np.flatnonzero(text == ord(" ")), at)
    counts = np.diff(blanks) + np.diff(np.searchsorted(cuts, at)) + 1
    joined = np.insert(text, np.concatenate((cuts, at[1:-1])), ord(" "))
    whole = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, len(joined)])), pa.py_buffer(joined))
    parts = pa.compute.split_pattern(whole, " ").flatten().dictionary_encode()
    distinct = pa.ListArray.from_arrays(pa.array([0, len(parts.dictionary)], pa.int32()), parts.dictionary)
    return pa.compute.binary_join(distinct, pa.scalar(" ", pa.large_string()))[0].as_py().split(" "), parts.indices.to_numpy(), counts


class WordTokens:
    """Token ids of texts, from the ids of their parts between blanks.

    The tokenizer never looks across these, so equal parts have equal ids and
    are encoded once (within a bound on what is remembered).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.places.update(zip(words, range(len(self.places), len(self.places) + len(words)), strict=True))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(sizes)))
        self.ids = np.concatenate((self.ids, ids.astype(np.uint32)))

    def _encode_new(self, words: list[str]) -> None:
        rest = [w for w in words if not w.isalpha()]
        letters = [w for w in words if w.isalpha()]
        for start in range(0, len(letters), _TOGETHER):
            # words of letters are encoded in one go: each one ends with an id that ends a word
            some = letters[start : start + _TOGETHER]
            ids = np.array(self._ids([" ".join(some)])[0], np.int64)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                self._learn(some, ids, np.diff(ends, prepend=0))
            else:
                rest += some
        encoded = self._ids(rest)
        flat = np.array([i for ids in encoded for i in ids], np.int64)
        self._learn(rest, flat, np.fromiter(map(len, encoded), np.int64, len(encoded)))

    def encode(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids start; texts as bytes and where each starts."""
        if len(self.places) > _CACHED_WORDS or len(self.ids) > _CACHED_IDS:
            self.clear()
        words, number, counts = _parts(flat, at)
        self._encode_new([w for w in words if w not in self.places])
        place = np.array([self.places[w] for w in words], np.int64)[number]
        ids = pa.LargeListArray.from_arrays(pa.array(self.starts), pa.array(self.ids)).take(pa.array(place))
        edges = ids.offsets.to_numpy()[np.concatenate(([0], np.cumsum(counts)))]
        return ids.flatten().to_numpy(), edges


_TOKENS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The encoder of this Python process, which later tasks find again."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def _cut(batches: Iterator[pa.RecordBatch], path: str, window: int, forget: bool) -> Iterator[pa.RecordBatch]:
    tokens, seen, task = word_tokens(path), Counter(), TaskContext.get().partitionId()
    for whole in batches:
        for first, stop in text_slices(whole, "text", size=_SLICE):
            batch = whole.slice(first, stop - first)
            ids, edges = tokens.encode(*utf8(batch.column("text")))
            rows: list[tuple] = []
            for row in range(batch.num_rows):
                own = np.append(ids[edges[row] : edges[row + 1]], END).astype("<u4")
                raw = own.tobytes()
                for start in range(0, len(own), window):
                    length = min(window, len(own) - start)
                    crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                    rows.append((row, start, length, crc, len(own), seen[length]))
                    seen[length] += 1
            columns = np.array(rows, np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(columns[0])), *map(pa.array, columns[1:]), pa.array(np.full(len(rows), task))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth", "task"],
            )
        if forget:
            tokens.clear()


def fitted_counts(histogram: np.ndarray, combinations: list[tuple[int, ...]], sweeps: int = 60) -> np.ndarray:
    """Non-negative least squares by coordinate descent: combinations times counts close to the histogram."""
    counts = np.zeros(len(combinations))
    rest = histogram.astype(float).copy()
    uses = [Counter(c) for c in combinations]
    squares = [sum(n * n for n in u.values()) for u in uses]
    for _ in range(sweeps):
        moved = 0.0
        for i, use in enumerate(uses):
            step = sum(n * rest[length] for length, n in use.items()) / squares[i]
            step = max(step, -counts[i])
            if step:
                counts[i] += step
                moved = max(moved, abs(step))
                for length, n in use.items():
                    rest[length] -= n * step
        if moved < 1e-3:
            break
    return counts


def combinations_for(histogram: np.ndarray, window: int, anchors: int = 48) -> list[tuple[int, ...]]:
    """Fillings of a window: all pairs, and triples of two out of `anchors` lengths with what completes them."""
    present = np.flatnonzero(histogram[:window])
    there = set(present.tolist())
    found = [(i, window - i) for i in there if i <= window - i and window - i in there]
    common = sorted(present[np.argsort(-histogram[present], kind="stable")][:anchors].tolist())
    spread = present[np.linspace(0, len(present) - 1, min(anchors, len(present))).astype(int)].tolist() if len(present) else []
    for picked in (common, spread):
        found += [
            tuple(sorted((i, j, window - i - j))) for n, i in enumerate(picked) for j in picked[n:] if window - i - j in there
        ]
    return sorted(set(found))


@dataclass
class Plan:
    """Runs of pieces by (length, first): piece `first + n` goes to sequence `sequence + n`, at `offset`."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def plan(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """Places for all pieces of a histogram of lengths (index: length, up to the window)."""
    left = histogram.astype(np.int64).copy()
    repeats: list[tuple[tuple[int, ...], int]] = []

    def use(combination: tuple[int, ...], times: int) -> None:
        need = Counter(combination)
        times = min(times, *(int(left[length]) // n for length, n in need.items()))
        if times > 0:
            repeats.append((combination, times))
            for length, n in need.items():
                left[length] -= n * times

    use((window,), int(left[window]))
    fillings = combinations_for(left, window)
    counts = np.floor(fitted_counts(left, fillings) + 1e-6).astype(np.int64)
    for i in np.argsort(-counts, kind="stable"):
        use(fillings[i], int(counts[i]))
    for filling in fillings:  # what rounding has left of exact fillings
        use(filling, int(left.max(initial=0)))
    while left.any():
        lengths = np.flatnonzero(left)
        combination, room, free = [], window, left.copy()
        while room:
            fit = lengths[(lengths <= room) & (free[lengths] > 0)]
            if not len(fit):
                break
            combination.append(int(fit[-1]))
            free[fit[-1]] -= 1
            room -= int(fit[-1])
        use(tuple(combination), int(left.max()))
    taken, runs, sequence = np.zeros(window + 1, np.int64), [], 0
    for combination, times in repeats:
        offset = 0
        for length in combination:
            runs.append((length, taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    table = np.array(sorted(runs), np.int64).reshape(-1, 4).T
    return Plan(*table)


def _placed(batches: Iterator[pa.RecordBatch], where: Plan) -> Iterator[pa.RecordBatch]:
    span = int(where.first.max(initial=0)) + 1
    keys = where.length * span + where.first
    for batch in batches:
        number = batch.column("number").to_numpy()
        key = batch.column("length").to_numpy() * span + np.minimum(number, span - 1)
        run = np.searchsorted(keys, key, side="right") - 1
        columns = {c: batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
        columns["sequence_id"] = pa.array(where.sequence[run] + number - where.first[run])
        columns["offset"] = pa.array(where.offset[run])
        yield pa.RecordBatch.from_pydict(columns)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, forget: bool = False) -> DataFrame:
    """One row per piece of a document of `docs` (doc_id, text): where it comes from and where it goes.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), as long
    integers.  A null text counts as empty and is its end id alone.  Every row
    is a document of its own, also one that repeats a doc_id or has none.
    Sequences hold at most `window` ids; pieces in one stand without gaps from
    offset 0.  An empty table gives no rows.  Other columns are not read.
    `forget` drops the ids of known words after every batch, which costs time, for
    sessions whose other stages need the memory.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, nth bigint, task bigint"
    pieces = keep(texts.mapInArrow(partial(_cut, path=tokenizer, window=window, forget=forget), schema), "pieces")
    per_task = keep(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(window + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row for each length up to the window
        histogram[row["length"]] = row["n"]
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = pieces.join(offsets, ["length", "task"]).withColumn("number", F.col("nth") + F.col("before"))
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "number").mapInArrow(
        partial(_placed, where=plan(histogram, window)), schema
    )
