"""Byte-level BPE with DuckDB inside the tasks.

A partition's distinct words (matches of the tokenizer's pattern) become rows
(word, position, token), one for each byte.  A recursive query joins
neighbouring tokens to the merge table and contracts each word's leftmost pair
of the lowest rank, until no pair is left that the table knows.  Decoding joins
ids to their bytes and puts them together by an ordered aggregate.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial
from hashlib import sha256
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.arrays import SPACE, strings, text_slices, utf8

_REMEMBERED = 1_200_000
_REMEMBERED_PARTS = 800_000
_LONG_WORD = 255
_WORDS_AT_ONCE = 50_000
_MEMORY = "300MB"
_SLICE = 4 << 20

# Neighbours that the merge table knows, with the position after the next one.
_NEIGHBOURS = """
  select w, p, t, m, np from (
    select w, p, t, t::bigint * 65536 + lead(t) over places as pair, lead(p) over places as np from state where live
    window places as (partition by w order by p)
  ) left join merges using (pair)
"""

# One contraction for each word and step.  The key orders by rank, then by
# position, and carries the position that the contraction takes away.
_SHORT = f"""
with recursive state(w, p, t, live) as (
  select w, p, t, true from start
  union all (
    with near as materialized ({_NEIGHBOURS}),
    top as materialized (
      select w, min((m::bigint << 16) | (p << 8) | np) as best from near where m is not null group by w
    )
    select near.w, p, case when p = (best >> 8) & 255 then (best >> 16)::int else t end, best is not null
    from near left join top on near.w = top.w where best is null or p <> best & 255
  )
)
select w, p, t from state where not live order by w, p
"""

# All pairs of the lowest rank at once, every other one where they overlap, if
# no pair with the new token has a lower rank than that token: then nothing
# could come in between, and the outcome is that of one after another.
_LONG = f"""
with recursive state(w, p, t, live) as (
  select w, p, t, true from start
  union all
  select w, p, t, live from (
    select w, p, case when taken then best else t end as t, best is not null as live,
      lag(taken, 1, false) over (partition by w order by p) as gone
    from (
      select w, p, t, best,
        case when not hit then false when best in (select m from touchy) then p = least_p
          else row_number() over (partition by w, hit, run order by p) % 2 = 1 end as taken
      from (
        select *, min(case when hit then p end) over (partition by w) as least_p,
          row_number() over (partition by w order by p) - row_number() over (partition by w, hit order by p) as run
        from (
          select *, coalesce(m = best, false) as hit from (
            select w, p, t, m, min(m) over (partition by w) as best from ({_NEIGHBOURS})
          )
        )
      )
    )
  ) where not gone
)
select w, p, t from state where not live order by w, p
"""


class Codec:
    """Encodes and decodes words by the ranks of one file; remembers words, within a bound."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.pattern = regex.compile(pattern)
        self.db = duckdb.connect()
        self.db.execute(f"set threads = 1; set memory_limit = '{_MEMORY}'")
        rows = [
            (self.ranks[token[:i]], self.ranks[token[i:]], rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if token[:i] in self.ranks and token[i:] in self.ranks
        ]
        left, right, merged = np.array(rows, np.int64).reshape(-1, 3).T
        merges = self._table({"pair": left * 65536 + right, "l": left, "r": right, "m": merged})
        known = pa.table({"id": list(self.ranks.values()), "hex": [t.hex() for t in self.ranks]})
        for name, table in (("merges", merges), ("tokens", known)):
            self.db.register("given", table)
            self.db.execute(f"create table {name} as select * from given")
            self.db.unregister("given")
        self.db.execute("create table touchy as select distinct greatest(l, r) as m from merges where m < greatest(l, r)")
        self.db.execute("alter table merges alter m type int")
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.words: dict[str, tuple[int, str, bytes]] = {}
        self.parts: dict[str, tuple[int, str, bytes]] = {}

    @staticmethod
    def _table(columns: dict[str, np.ndarray], kind: pa.DataType | None = None) -> pa.Table:
        return pa.table({k: pa.array(v.astype(np.int32) if kind else v, kind or pa.int64()) for k, v in columns.items()})

    def _contracted(self, words: list[bytes], query: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and where each word's ids start."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        tokens = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        self.db.register("start", self._table({"w": owner, "p": place, "t": tokens}, pa.int32()))
        found = self.db.sql(query).to_arrow_table()
        self.db.unregister("start")
        return found.column("t").to_numpy(), np.searchsorted(found.column("w").to_numpy(), np.arange(len(words) + 1))

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
        """The bytes of each sequence of ids (`edges`: where each one starts)."""
        owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        self.db.register("coded", self._table({"w": owner, "p": np.arange(len(ids)), "id": ids}))
        found = self.db.sql(
            "select w, string_agg(hex, '' order by p) as hex from coded join tokens using (id) group by w"
        ).to_arrow_table()
        self.db.unregister("coded")
        out = [b""] * (len(edges) - 1)
        for w, text in zip(found.column("w").to_pylist(), found.column("hex").to_pylist(), strict=True):
            out[w] = bytes.fromhex(text)
        return out

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        whole = [self.ranks.get(b) for b in raw]
        for is_long, query in ((False, _SHORT), (True, _LONG)):
            some = [i for i, b in enumerate(raw) if whole[i] is None and (len(b) > _LONG_WORD) == is_long]
            for at in range(0, len(some), _WORDS_AT_ONCE):
                part = some[at : at + _WORDS_AT_ONCE]
                ids, edges = self._contracted([raw[i] for i in part], query)
                self._remember([words[i] for i in part], ids, edges)
        single = [i for i, rank in enumerate(whole) if rank is not None]
        self._remember([words[i] for i in single], np.array([whole[i] for i in single], np.int64), np.arange(len(single) + 1))

    def _remember(self, words: list[str], ids: np.ndarray, edges: np.ndarray) -> None:
        plain, cuts = list(map(str, ids.tolist())), edges.tolist()
        for word, text, a, b in zip(words, self.decode(ids, edges), cuts, cuts[1:], strict=False):
            self.words[word] = (b - a, " ".join(plain[a:b]), text)

    def _add(self, parts: list[str]) -> None:
        """Learn parts of texts: their pieces by the pattern, and the pieces' ids."""
        if len(self.words) > _REMEMBERED:
            self.words.clear()
        pieces = [self.pattern.findall(p) for p in parts]
        new = set(chain.from_iterable(pieces)).difference(self.words)
        if new:
            self._learn(list(new))
        for part, words in zip(parts, pieces, strict=True):
            if len(words) == 1:
                self.parts[part] = self.words[words[0]]
            else:
                found = [self.words[w] for w in words]
                self.parts[part] = (sum(f[0] for f in found), " ".join([f[1] for f in found]), b"".join([f[2] for f in found]))

    def encode(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """For each text the number of its ids, the ids in decimal, and the bytes they stand for.

        Texts come as bytes and where each one starts.  No match of the pattern
        goes on over white space that follows something else, so texts are cut
        there, and each distinct part is looked up once.
        """
        if len(self.parts) > _REMEMBERED_PARTS:
            self.parts.clear()
        blank = SPACE[flat]
        begins = np.zeros(len(flat) + 1, bool)
        begins[1:-1] = ~blank[:-1] & blank[1:]
        begins[at] = True
        starts = np.flatnonzero(begins[:-1])
        edges = np.append(starts, len(flat))
        cut = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(flat)))
        coded = cut.dictionary_encode()
        distinct = strings(coded.dictionary)
        new = [p for p in distinct if p not in self.parts]
        for first in range(0, len(new), _WORDS_AT_ONCE):
            self._add(new[first : first + _WORDS_AT_ONCE])
        found = [self.parts[p] for p in distinct]
        number = coded.indices
        per_text = np.searchsorted(starts, at).astype(np.int32)
        counts = np.concatenate(([0], np.cumsum(np.array([f[0] for f in found], np.int64)[number.to_numpy()])))[per_text]

        def joined(values: list, kind: pa.DataType, between: str | bytes) -> pa.Array:
            lists = pa.ListArray.from_arrays(pa.array(per_text), pa.array(values, kind).take(number))
            return pa.compute.binary_join(lists, pa.scalar(between, kind))

        return np.diff(counts), joined([f[1] for f in found], pa.string(), " "), joined([f[2] for f in found], pa.binary(), b"")


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of this Python process, which later tasks find again."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without garbage collection: what is remembered holds no cycles, and would be searched for some over and over."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def _coded(batches: Iterator[pa.RecordBatch], path: str, pattern: str, digests: bool) -> Iterator[pa.RecordBatch]:
    coder = codec(path, pattern)
    kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary())
    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    with _uncollected():
        for whole in batches:
            for start, stop in text_slices(whole, "text", size=_SLICE):
                batch = whole.slice(start, stop - start)
                counts, plain, texts = coder.encode(*utf8(batch.column("text")))
                if digests:
                    ids = [sha256(p.encode()).hexdigest() for p in plain.to_pylist()]
                    texts = pa.array([sha256(t).hexdigest() for t in texts.to_pylist()], kinds[1])
                else:
                    ids = [list(map(int, p.split())) for p in plain.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, kinds[0]), texts], ["doc_id", "n_tokens", *names]
                )


def round_trip(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for every row of `docs` (doc_id, text).

    `ids` are the token ids of the whole text, `decoded` the bytes that these
    ids stand for; with `digests`, both come as SHA-256 in lower-case hex (ids
    in decimal, joined by one space).  A null or empty text has no ids.  Rows
    are coded one by one, so repeated rows and null ids stay as they are; an
    empty table gives no rows, and other columns are not read.
    """
    out = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        partial(_coded, path=path, pattern=pattern, digests=digests), f"doc_id bigint, n_tokens bigint, {out}"
    )


def _joined(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    coder = codec(path, pattern)
    for batch in batches:
        lists = batch.column("ids").to_pylist()
        edges = np.concatenate(([0], np.cumsum([len(x or ()) for x in lists]))).astype(np.int64)
        flat = np.array([i for x in lists for i in x or ()], np.int64)
        decoded = coder.decode(flat, edges)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(decoded, pa.binary())], ["doc_id", "decoded"])


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded) for rows (doc_id, ids); a null list decodes to no bytes, unknown ids to none."""
    rows = coded.select("doc_id", F.col("ids").cast("array<bigint>").alias("ids"))
    return rows.mapInArrow(partial(_joined, path=path, pattern=pattern), "doc_id bigint, decoded binary")
