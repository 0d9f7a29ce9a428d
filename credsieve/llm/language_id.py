"""Language identification by rank-order profiles of character n-grams.

Every language gets the list of its most frequent n-grams (one to three
letters, with word ends), counted over all training documents.  A document is
compared to each list by the out-of-place distance: the sum of the differences
in rank of the document's own most frequent n-grams, where an n-gram that the
language's list lacks counts as far as the list is long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credsieve.llm.arrays import text_slices

PROFILE = 400
UNKNOWN = "und"
_BITS, _KIND = 18, 54
_DOCUMENT = 56
_HELD_ENTRIES = 1 << 20
_CELLS = 1 << 21
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """A table by code point: the code itself for a letter, else 0.  All letters lie below 2**18."""
    if not _LETTER:
        codes = np.arange(1 << _BITS, dtype=np.uint32)
        codes[[not chr(c).isalpha() for c in range(1 << _BITS)]] = 0
        _LETTER.append(codes)
    return _LETTER[0]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, n-gram) keys in rising order and their counts, for at most 256 texts."""
    table, keys = _letters(), []
    joined = np.frombuffer("".join(f" {t.lower()} " for t in texts).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t.lower()) + 2 for t in texts], np.int64)
    code = np.where(joined < len(table), table[np.minimum(joined, len(table) - 1)], 0).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64) << np.uint64(_DOCUMENT), lengths)
    bits = np.uint64(_BITS)
    letter = code > 0
    at = np.flatnonzero(letter)
    keys.append(owner[at] | code[at])
    pair = np.flatnonzero(letter[:-1] | letter[1:])
    two = code[pair] << bits | code[pair + 1]
    keys.append(owner[pair] | np.uint64(1 << _KIND) | two)
    keys.append(owner[at] | np.uint64(2 << _KIND) | code[at - 1] << np.uint64(2 * _BITS) | code[at] << bits | code[at + 1])
    every = np.concatenate(keys)
    every.sort()
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
    return every[first], np.diff(np.concatenate((first, [len(every)])))


def _pieces(text: str) -> list[str]:
    """A long text in parts of a million characters, cut at white space where there is some near."""
    parts, start = [], 0
    while len(text) - start > 1 << 20:
        stop = text.rfind(" ", start + (1 << 19), start + (1 << 20))
        stop = start + (1 << 20) if stop < 0 else stop
        parts.append(text[start:stop])
        start = stop
    return [*parts, text[start:]]


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the counts of equal keys, keys rising."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _counted(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, keys, counts) of the slices of a batch; keys carry row - first row."""
    column = batch.column("text")
    for start, stop in text_slices(batch, "text", 256):
        texts = [t or "" for t in column.slice(start, stop - start).to_pylist()]
        if len(texts) == 1 and len(texts[0]) > 1 << 20:
            parts = [_grams([p]) for p in _pieces(texts[0])]
            yield start, stop, *_merge(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
        else:
            yield start, stop, *_grams(texts)


def _language_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    entries = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        for name, parts in held.items():
            keys, counts = _merge(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts)],
                ["lang", "gram", "n"],
            )
        held.clear()

    for batch in batches:
        names = batch.column("lang").to_pylist()
        for start, stop, keys, counts in _counted(batch):
            owner = (keys >> np.uint64(_DOCUMENT)).astype(np.int64)
            grams = keys & np.uint64((1 << _DOCUMENT) - 1)
            edges = np.searchsorted(owner, np.arange(stop - start + 1))
            by_name: dict[str, list[np.ndarray]] = {}
            for row in range(stop - start):
                by_name.setdefault(names[start + row], []).append(np.arange(edges[row], edges[row + 1]))
            for name, parts in by_name.items():
                picked = np.concatenate(parts)
                held.setdefault(name, []).append(_merge(grams[picked], counts[picked]))
                entries += len(held[name][-1][0])
            if entries > _HELD_ENTRIES:
                for name, parts in held.items():
                    held[name] = [_merge(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))]
                entries = sum(len(parts[0][0]) for parts in held.values())
                if entries > _HELD_ENTRIES // 2:
                    yield from flushed()
                    entries = 0
    yield from flushed()


def profiles(training: DataFrame, size: int = PROFILE) -> DataFrame:
    """Rows (lang, gram, place) with the `size` most frequent n-grams of each language.

    `training` has the columns lang and text.  Rows with a null in either are
    left out.  Ties in frequency go to the smaller n-gram code.  Counts are
    merged inside the tasks and before the shuffle, and the first `size` rows
    per language are taken before they are shuffled, so that one language may
    hold any share of the rows.
    """
    counted = (
        training.select("lang", "text")
        .where("lang is not null and text is not null")
        .mapInArrow(_language_counts, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    return counted.withColumn("place", place).where(F.col("place") <= size).select("lang", "gram", "place")


@dataclass
class Lists:
    """The lists of all languages, by n-gram: those that have n-gram i are entries edges[i] to edges[i + 1]."""

    names: list[str]
    grams: np.ndarray
    edges: np.ndarray
    languages: np.ndarray
    places: np.ndarray

    def nearest(self, owner: np.ndarray, gram: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(language, nearness) for each text of entries sorted by `owner`, which counts from 0 without gaps.

        Nearness is by how much the distance falls short of the largest one,
        that to a list which shares no n-gram with the text.  So only shared
        n-grams take part, whatever the number of languages.
        """
        many = len(self.names)
        texts = int(owner[-1]) + 1
        best, nearness = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        known = np.flatnonzero(self.grams[at] == gram)
        owner, place, at = owner[known], place[known], at[known]
        step = max(1, _CELLS // many)
        for first in range(0, texts, step):
            low, high = np.searchsorted(owner, [first, min(first + step, texts)])
            begin, end = self.edges[at[low:high]], self.edges[at[low:high] + 1]
            shared = end - begin
            entry = np.arange(shared.sum()) + np.repeat(begin - (np.cumsum(shared) - shared), shared)
            gain = size - np.abs(self.places[entry] - np.repeat(place[low:high], shared))
            cell = np.repeat(owner[low:high] - first, shared) * many + self.languages[entry]
            held = min(step, texts - first)
            total = np.bincount(cell, weights=gain, minlength=held * many).astype(np.int64).reshape(held, many)
            best[first : first + held] = total.argmax(axis=1)
            nearness[first : first + held] = total.max(axis=1)
        return best, nearness


def _lists(table: DataFrame) -> Lists:
    """All profiles: as many rows as there are languages, times the length of a list at most."""
    rows = table.select("lang", "gram", "place").toArrow().combine_chunks()
    names = sorted(rows.column("lang").unique().to_pylist())
    number = pc.index_in(rows.column("lang"), pa.array(names, pa.string())).to_numpy()
    gram = rows.column("gram").to_numpy().astype(np.uint64)
    order = np.lexsort((number, gram))
    grams, first = np.unique(gram[order], return_index=True)
    return Lists(names, grams, np.append(first, len(order)), number[order].astype(np.int64), rows.column("place").to_numpy()[order].astype(np.int64) - 1)


def identify(
    docs: DataFrame, table: DataFrame, size: int = PROFILE, returned: list[str] | None = None
) -> DataFrame:
    """`docs` (or its columns named in `returned`) with lang_pred and score (0 to 1) appended, from the column text alone.

    A null text, or one without a letter, gets `und` and score 0; so does every
    text if there is no profile.  Equal distances go to the language that comes
    first in code point order.  Columns of `docs` named lang_pred or score are
    replaced.  Repeated rows get equal answers.
    """
    lists = _lists(table)
    names = lists.names
    kept = [c for c in returned or docs.columns if c.lower() not in ("lang_pred", "score")]

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = np.full(batch.num_rows, -1, np.int64)
            score = np.zeros(batch.num_rows)
            for start, stop, keys, counts in _counted(batch):
                if not len(keys) or not names:
                    continue
                owner = (keys >> np.uint64(_DOCUMENT)).astype(np.int64)
                # rising n-grams stay in order among equal counts: the sort is stable
                order = np.argsort((owner << 40) - counts, kind="stable")
                owner = owner[order]
                place = np.arange(len(owner)) - np.searchsorted(owner, owner)
                used = place < size
                owner, place = owner[used], place[used]
                gram = keys[order][used] & np.uint64((1 << _DOCUMENT) - 1)
                first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                rows, own = start + owner[first], np.diff(np.concatenate((first, [len(owner)])))
                best[rows], near = lists.nearest(np.repeat(np.arange(len(first)), own), gram, place, size)
                score[rows] = 1 - (size * own - near) / (size * own)
            named = pa.array([names[b] if b >= 0 else UNKNOWN for b in best.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), named, pa.array(score)], [*kept, "lang_pred", "score"]
            )

    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(predicted, schema)
