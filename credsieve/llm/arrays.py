"""Vectorised text helpers that run inside Arrow batches.

Everything here works on flat numpy arrays of a slice of documents, so that no
Python code runs per character, and slices are bounded in bytes, so that the
memory of a task does not depend on how many or how long the documents are.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

SLICE_BYTES = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POWERS: list[np.ndarray] = []


def text_slices(
    batch: pa.RecordBatch, column: str, rows: int = 1 << 16, size: int = SLICE_BYTES
) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that hold about `size` bytes of text, at least one row each."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, own in enumerate(sizes.tolist()):
        if row > start and (held + own > size or row - start >= rows):
            yield start, row
            start, held = row, 0
        held += own
    if start < len(sizes):
        yield start, len(sizes)
    _give_back()


def _give_back() -> None:
    """Return freed memory to the system: workers live on, and tasks of other stages follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each text starts (null: empty)."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def strings(column: pa.Array) -> list[str]:
    """The texts of a column without nulls, decoded in one go."""
    flat, at = utf8(column)
    whole = flat.tobytes().decode()
    if len(whole) < len(flat):
        at = np.concatenate(([0], np.cumsum((flat & 0xC0) != 0x80)))[at]
    edges = at.tolist()
    return [whole[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = values.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < length:
        size = max(length, SLICE_BYTES + 1)
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        _POWERS[:] = [
            np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, base, np.uint64), dtype=np.uint64)))
            for base in (_MULTIPLIER, inverse)
        ]
    return _POWERS[0][:length], _POWERS[1][:length]


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def word_hashes(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's words start.

    Words are runs of bytes other than space and 0x09 to 0x0D, with A-Z in
    lower case.  A word's hash is a polynomial over its bytes, read off a
    running sum, and then scrambled.  A slice longer than SLICE_BYTES (one very
    long text) is hashed in pieces cut between words.
    """
    hashes, counts = [], np.zeros(len(at) - 1, np.int64)
    start = 0
    while start < len(flat):
        stop = min(start + 2 * SLICE_BYTES, len(flat))
        if stop < len(flat):
            border = int(at[np.searchsorted(at, stop)])
            spaces = np.flatnonzero(SPACE[flat[stop:border]])
            stop = stop + int(spaces[0]) if len(spaces) else border
        piece = flat[start:stop]
        space = SPACE[piece]
        edge = np.ones(len(piece) + 1, bool)
        edge[1:-1] = space[1:] != space[:-1]
        cuts = at[(at > start) & (at < stop)] - start
        edge[cuts] = True
        bounds = np.flatnonzero(edge)
        begin, end = bounds[:-1], bounds[1:]
        word = ~space[begin]
        begin, end = begin[word], end[word]
        up, down = _powers(len(piece) + 1)
        running = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[_LOWER[piece]] * up[:-1], out=running[1:])
        hashes.append(mix((running[end] - running[begin]) * down[begin] + (end - begin).astype(np.uint64)))
        owner = np.searchsorted(at, begin + start, side="right") - 1
        counts += np.bincount(owner, minlength=len(counts))
        start = stop
    where = np.concatenate(([0], np.cumsum(counts)))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), where


def shingle_hashes(words: np.ndarray, where: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of each text's distinct shingles in rising order, and where each text's set starts.

    A text with fewer words than a shingle has its whole sequence as one
    shingle; a text without words has an empty set.
    """
    lengths = np.diff(where)
    spans = np.where(lengths >= size, lengths - size + 1, (lengths > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(lengths)), spans)
    first = np.repeat(where[:-1] - np.concatenate(([0], np.cumsum(spans)[:-1])), spans) + np.arange(len(owner))
    held = np.minimum(lengths, size)[owner]
    code = held.astype(np.uint64)
    padded = np.concatenate((words, np.zeros(size, np.uint64)))
    for k in range(size):
        taken = padded[first + k]
        code = np.where(held > k, mix(code * np.uint64(_MULTIPLIER) + taken), code)
    code = (code >> np.uint64(1)).astype(np.int64)
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    fresh = np.ones(len(code), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    code, owner = code[fresh], owner[fresh]
    return code, np.searchsorted(owner, np.arange(len(lengths) + 1))


def ragged(values: np.ndarray, where: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list column of the parts of a flat array."""
    flat = pa.array(values, kind) if kind else pa.array(values)
    return pa.ListArray.from_arrays(pa.array(where, pa.int32()), flat)
