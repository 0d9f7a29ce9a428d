"""Documents that hold passages of a benchmark, by winnowed fingerprints.

A window is 10 words in a row.  It holds six grams of 5 words, and the smallest
gram hash among them (the last one, if equal) is the window's fingerprint.  The
choice depends on nothing but the window's words, so a window that occurs in a
document has the same fingerprint there: no shared span of 10 words is missed.
An item with fewer words is a window by itself, and its whole hash the
fingerprint, which every gram of that length in a document is compared with.

Fingerprints of documents that a bit table of the benchmark's lets pass are
joined with these, and hits are extended to both sides, word by word, over the
words themselves.  Five words to each side are enough, since no window with the
fingerprint reaches further; what hits have in common is counted once.  So the
work a hit takes has a bound, however often a text repeats itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsieve.llm.arrays import text_slices, utf8
from credsieve.llm.tokens import BitTable, Words, byte_set, joint
from credsieve.session import keep

WINDOW = 10
GRAM = 5
#: Bytes between words: everything of ASCII but digits and letters.
GAP = byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Bytes of benchmark fingerprints with their words that are sent to all tasks; more are joined by a shuffle.
SENT_BYTES = 32 << 20
_SALTS = 32
_MARK = "short int, code bigint, at bigint, lead int, words array<string>"


def _winnowed(words: Words) -> np.ndarray:
    """Numbers of the words at which the fingerprint of some window begins, and all gram codes."""
    span = WINDOW - GRAM + 1
    n = len(words)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = joint(words.code[k : n - GRAM + 1 + k] for k in range(GRAM))
    left = np.repeat(words.where[1:], np.diff(words.where)) - np.arange(n)
    starts = np.flatnonzero(left[: n - WINDOW + 1] >= WINDOW)
    best, place = grams[starts], np.zeros(len(starts), np.int64)
    for k in range(1, span):
        here = grams[starts + k]
        less = here <= best
        best, place = np.where(less, here, best), np.where(less, k, place)
    return np.unique(starts + place), grams


def _marks(words: Words, lengths: list[int] | None, wanted: BitTable | None) -> tuple[list, np.ndarray]:
    """Fingerprints as tuples (short, code, at, lead, words) and which text has each.

    `lengths` are those of short items to look for (None: the texts are items
    themselves, and a short one has one fingerprint, its whole).
    """
    found, owners = [], []
    owner, first = words.owner(), words.where[:-1]
    at, grams = _winnowed(words)
    if wanted is not None:
        at = at[wanted.holds(grams[at])]
    for i in at.tolist():
        start, stop = first[owner[i]], words.where[owner[i] + 1]
        low, high = max(i - (WINDOW - GRAM), start), min(i + WINDOW, stop)
        found.append((0, int(grams[i]), int(i - start), int(i - low), [words.text(j) for j in range(low, high)]))
        owners.append(int(owner[i]))
    sizes = np.diff(words.where)
    for length in lengths if lengths is not None else range(1, WINDOW):
        if lengths is None:
            at = first[sizes == length]
        else:
            left = np.repeat(words.where[1:], sizes) - np.arange(len(words))
            at = np.flatnonzero(left >= length)
        codes = joint(words.code[at + k] for k in range(length)) if len(at) else np.zeros(0, np.uint64)
        if wanted is not None:
            held = wanted.holds(codes)
            at, codes = at[held], codes[held]
        for i, code in zip(at.tolist(), codes.tolist(), strict=True):
            found.append((length, code, int(i - first[owner[i]]), 0, [words.text(j) for j in range(i, i + length)]))
            owners.append(int(owner[i]))
    return found, np.array(owners, np.int64)


_MARK_TYPE = pa.struct([("short", pa.int32()), ("code", pa.int64()), ("at", pa.int64()), ("lead", pa.int32()), ("words", pa.list_(pa.string()))])


def _marked(batches: Iterator[pa.RecordBatch], lengths: list[int] | None, wanted) -> Iterator[pa.RecordBatch]:
    """(id, print, n_words, marks) of every row (id, print, text)."""
    table = wanted.value if wanted is not None else None
    names = [f.name for f in _MARK_TYPE]
    for batch in batches:
        for start, stop in text_slices(batch, "text"):
            part = batch.slice(start, stop - start)
            words = Words(*utf8(part.column("text")), GAP)
            found, owners = _marks(words, lengths, table)
            order = np.argsort(owners, kind="stable").tolist()
            rows = pa.array([dict(zip(names, found[i], strict=True)) for i in order], _MARK_TYPE)
            edges = np.searchsorted(np.sort(owners), np.arange(stop - start + 1))
            marks = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), rows)
            counts = pa.array(np.diff(words.where))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("print"), counts, marks], ["id", "print", "n_words", "marks"]
            )


def _fingerprints(rows: DataFrame, kind: str, lengths: list[int] | None = None, wanted=None) -> DataFrame:
    return rows.mapInArrow(
        partial(_marked, lengths=lengths, wanted=wanted), f"id {kind}, print bigint, n_words bigint, marks array<struct<{_MARK.replace(' ', ':').replace(',:', ',')}>>"
    )


def _steps(conditions: list[Column]) -> Column:
    """How many conditions hold one after another."""
    total = F.lit(len(conditions))
    for n, condition in reversed(list(enumerate(conditions))):
        total = F.when(F.coalesce(condition, F.lit(False)), total).otherwise(F.lit(n))
    return total


def _extended(hits: DataFrame) -> DataFrame:
    """(id, print, content, start, stop): words that a window covers, of document marks `d` joined with contents `c`."""
    word = lambda side, place: F.get(F.col(f"{side}.words"), place)
    at = lambda side, k: word(side, F.col(f"{side}.lead") + k)
    more = WINDOW - GRAM
    # an index below 0 gives null, as one behind the end does
    left = _steps([at("d", -k) == at("c", -k) for k in range(1, more + 1)])
    right = _steps([at("d", GRAM + k) == at("c", GRAM + k) for k in range(more)])
    same = F.slice("d.words", F.col("d.lead") + 1, GRAM) == F.slice("c.words", F.col("c.lead") + 1, GRAM)
    short = F.col("c.short") > 0
    found = hits.select("id", "print", "content", "d", "c", left.alias("left"), right.alias("right")).where(
        (short & (F.col("d.words") == F.col("c.words"))) | (~short & same & (F.col("left") + F.col("right") >= more))
    )
    return found.select(
        "id", "print", "content",
        F.when(short, F.col("d.at")).otherwise(F.col("d.at") - F.col("left")).alias("start"),
        F.when(short, F.col("d.at") + F.col("c.short")).otherwise(F.col("d.at") + GRAM + F.col("right")).alias("stop"),
    )


def _matched(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (id, print, n_words, marks), spans (id, print, content, start, stop) and owners (content, item_id)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.xxhash64("text").alias("print"), F.coalesce("text", F.lit("")).alias("text"))
    marks = keep(
        _fingerprints(items, "string").select(F.col("id").alias("item_id"), F.explode("marks").alias("m")).select(
            "item_id", "m.short", "m.code", "m.lead", "m.words"
        ).distinct(),
        "benchmark",
    )
    # one row for each content, so that passages that many items share are compared once
    content = ["short", "code", "lead", "words"]
    contents = keep(marks.select(*content).distinct().withColumn("content", F.monotonically_increasing_id()), "contents")
    owners = keep(marks.join(contents, content).select("content", "item_id"), "owners")
    size = F.sum(F.length(F.array_join("words", " ")) + 64)
    n, held = contents.agg(F.count("*"), size).first()
    lengths = sorted(r.short for r in contents.where("short > 0").select("short").distinct().collect())
    wanted = docs.sparkSession.sparkContext.broadcast(BitTable.of(contents, "code", n))
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("print"), F.coalesce("text", F.lit("")).alias("text"))
    read = keep(_fingerprints(texts, kind, lengths, wanted), "documents")
    met = read.where("size(marks) > 0").select("id", "print", F.explode("marks").alias("d")).withColumn("code", F.col("d.code"))
    met = met.withColumn("short", F.col("d.short"))
    known = contents.select("short", "code", "content", F.struct("short", "lead", "words").alias("c"))
    if (held or 0) <= SENT_BYTES:
        hits = met.join(F.broadcast(known), ["short", "code"])
    else:  # a fingerprint of very many documents is dealt to several tasks
        salt = F.pmod(F.xxhash64("print", "d.at"), F.lit(_SALTS)).cast("int").alias("salt")
        many = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        hits = met.select("*", salt).join(many, ["short", "code", "salt"])
    return read, _extended(hits), owners


def spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, start, stop, item_id): the words from start on and before stop that a window of an item covers.

    Spans of one item may overlap or touch.  Inputs as in `contaminated`.
    """
    _, found, owners = _matched(docs, benchmark)
    return found.join(owners, "content").select(F.col("id").alias("doc_id"), "start", "stop", "item_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, items) for every row of `docs` (doc_id, text); `benchmark` has (item_id, text).

    n_hit counts the words inside any occurrence of a window of the benchmark,
    `items` are the sorted ids, as strings, of items with such windows.  A null
    or wordless text has no words and no window.  Rows are judged one by one,
    also those that repeat a doc_id or lack one.  Rows of the benchmark that
    repeat an item_id are one item; what lacks an id hits words, but is in no
    list.  Empty tables and columns of other names change nothing else.
    """
    read, found, owners = _matched(docs, benchmark)
    found = keep(found, "spans")
    key = ["id", "print"]
    word = F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("word")
    words = found.select(*key, word).distinct().groupBy(*key).agg(F.count("*").alias("n_hit"))
    known = found.select(*key, "content").distinct().join(owners, "content").where("item_id is not null")
    listed = known.select(*key, "item_id").distinct().groupBy(*key).agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    none = F.lit(None).cast("array<string>")
    clean = read.where("size(marks) = 0").select("id", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("items"))
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & a["print"].eqNullSafe(b["print"])
    rest = read.where("size(marks) > 0").select(*key, "n_words")
    rest = rest.join(words, same(rest, words), "left").select(rest["id"], rest["print"], "n_words", "n_hit")
    judged = rest.join(listed, same(rest, listed), "left").select(
        rest["id"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), "items"
    )
    return clean.union(judged).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )
