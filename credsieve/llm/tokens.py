"""Words of many texts at once, as numpy arrays, and a small bit table to look codes up in.

What separates words is a parameter, a set of bytes.  Codes of words are 62-bit
hashes; whoever needs certainty compares the words themselves, or proves once
that no two words share a code.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsieve.llm.arrays import _MULTIPLIER, _powers, mix

CHUNK_BYTES = 1 << 20
LONG_WORD = 255
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def byte_set(*spans: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes lie in one of the spans, both ends included."""
    held = np.zeros(256, bool)
    for first, last in spans:
        held[first : last + 1] = True
    return held


def lowered(piece: np.ndarray) -> str:
    """A word as text, A-Z in lower case."""
    return _LOWER[piece].tobytes().decode()


class Words:
    """The words of some texts one after another.

    `begin` and `end` are byte places, `code` hashes of the lower-cased words,
    `where` the number of the first word of every text (and of the end), and
    `part` how many `breaks` bytes come before a word.
    """

    def __init__(self, flat: np.ndarray, at: np.ndarray, gap: np.ndarray, breaks: np.ndarray | None = None, seed: int = 0):
        self.flat = flat
        letters = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER) + np.uint64(seed))
        found, counts, passed, start = [], np.zeros(len(at) - 1, np.int64), 0, 0
        while start < len(flat):  # chunks end between words, so that a very long text needs no more memory a byte
            stop = min(start + CHUNK_BYTES, len(flat))
            if stop < len(flat):
                border = int(at[np.searchsorted(at, stop)])
                gaps = np.flatnonzero(gap[flat[stop:border]])
                stop = stop + int(gaps[0]) if len(gaps) else border
            begin, end, code = self._hashed(flat[start:stop], at[(at > start) & (at < stop)] - start, gap, letters, seed)
            part = np.zeros(len(begin), np.int64)
            if breaks is not None:
                before = np.concatenate(([0], np.cumsum(breaks[flat[start:stop]])))
                part = before[begin] + passed
                passed += int(before[-1])
            owner = np.searchsorted(at, begin + start, side="right") - 1
            counts += np.bincount(owner, minlength=len(counts))
            found.append((begin + start, end + start, code, part))
            start = stop
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.begin, self.end, self.code, self.part = (np.concatenate(x) for x in zip(*(found or [empty]), strict=True))
        self.where = np.concatenate(([0], np.cumsum(counts)))

    @staticmethod
    def _hashed(piece, cuts, gap, letters, seed):
        outside = gap[piece]
        edge = np.ones(len(piece) + 1, bool)
        edge[1:-1] = outside[1:] != outside[:-1]
        edge[cuts] = True
        bounds = np.flatnonzero(edge)
        begin, end = bounds[:-1], bounds[1:]
        inside = ~outside[begin]
        begin, end = begin[inside], end[inside]
        sizes = end - begin
        # a polynomial over the bytes of each word, read off a running sum
        up, down = _powers(len(piece) + 1)
        running = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(letters[_LOWER[piece]] * up[:-1], out=running[1:])
        code = (running[end] - running[begin]) * down[begin] + sizes.astype(np.uint64)
        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            whole = _LOWER[piece[begin[i] : end[i]]].tobytes()
            code[i] = int.from_bytes(blake2b(whole, digest_size=8, key=str(seed).encode()).digest(), "little")
        return begin, end, mix(code) >> np.uint64(2)

    def __len__(self) -> int:
        return len(self.code)

    def text(self, i: int) -> str:
        return lowered(self.flat[self.begin[i] : self.end[i]])

    def texts(self, at: np.ndarray) -> pa.Array:
        """Many words at once."""
        sizes = self.end[at] - self.begin[at]
        edges = np.concatenate(([0], np.cumsum(sizes)))
        data = _LOWER[self.flat[np.arange(edges[-1]) + np.repeat(self.begin[at] - edges[:-1], sizes)]]
        long = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data))
        return long.cast(pa.string())

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.where) - 1), np.diff(self.where))


def joint(columns: Iterable[np.ndarray]) -> np.ndarray:
    """62-bit codes of rows of codes."""
    total = None
    for k, column in enumerate(columns):
        values = column.astype(np.uint64)
        total = mix(values + np.uint64(k)) if total is None else mix(total * _ODD + values + np.uint64(k))
    return total >> np.uint64(2)


class BitTable:
    """Which codes may be among some wanted ones: two bits for each, of at most MOST_BITS in all.

    A wanted code always passes; others pass by chance, and nearly always once
    there are far more wanted codes than bits.  So it may save work, never decide.
    """

    MOST_BITS = 1 << 27

    def __init__(self, words: np.ndarray):
        self.words = words

    @property
    def bits(self) -> int:
        return len(self.words) * 64

    @classmethod
    def of(cls, codes: DataFrame, column: str, n: int) -> BitTable:
        """Gather the bits of a column of 62-bit codes; one row for each word of 64 bits reaches the driver."""
        bits = 1 << 10
        while bits < min(32 * n, cls.MOST_BITS):
            bits *= 2
        code: Column = F.col(column)
        places = F.array(code % bits, F.shiftright(code, 31) % bits)
        bit = F.explode(places).alias("bit")
        gathered = codes.select(bit).groupBy(F.shiftright("bit", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("held")
        )
        words = np.zeros(bits // 64, np.int64)
        got = gathered.toPandas()
        words[got["word"].to_numpy(np.int64)] = got["held"].to_numpy(np.int64)
        return cls(words.view(np.uint64))

    def holds(self, codes: np.ndarray) -> np.ndarray:
        codes = codes.astype(np.uint64)
        one = np.uint64(1)
        passed = np.ones(len(codes), bool)
        for place in (codes % np.uint64(self.bits), (codes >> np.uint64(31)) % np.uint64(self.bits)):
            passed &= (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & one).astype(bool)
        return passed
