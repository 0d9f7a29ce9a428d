"""Phrase collocations, from pairs of neighbouring ids counted in tiles.

Frequent words get ids by frequency.  Neighbouring ids are counted by tiles of
TILE x TILE ids: a tile with many occurrences is a dense array with an address
for every pair (`bincount`), all others are sorted coordinates.  The frequent
pairs are ranked by frequency in their turn; where two of them overlap, two
neighbouring pair ids are a phrase of three words, and so on: each round
counts neighbouring ids of the round before, which leaves out every phrase
that has an infrequent part.  Counts of the tasks are summed by Spark.

At most `head` ids a round are sent to the tasks, those of the most frequent.
What is frequent beyond these is known by the codes of its words and counted
by coordinates alone; a bit table keeps most of what is infrequent out.  So
what is sent has a bound, and the counts are exact in either way.

Words are told apart by 62-bit codes of language and word.  All words of the
corpus are counted by code first, and it is made sure that no two share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsieve.llm.arrays import text_slices, utf8
from credsieve.llm.tokens import BitTable, Words, byte_set, joint
from credsieve.session import keep

HEAD = 1 << 19
TILE = 1024
#: A tile with so many occurrences in one go is counted as a dense array.
DENSE = TILE * TILE // 16
_TOGETHER = 1 << 20
_SLICE = 1 << 21
_ROWS = 1 << 17
_SALTS = 16
_SEEDS = 8
#: Bytes between pieces, and between words.
BREAKS = byte_set(*((b, b) for b in b".,;:!?"), (0x0A, 0x0D))
GAP = BREAKS | byte_set((0x20, 0x20), (0x09, 0x09))
#: No id: an infrequent word or phrase, or the border of a piece.  Ids are 0 or more, all below are frequent without one.
NONE = -1


def _coded(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[Words, np.ndarray, list[str], np.ndarray]]:
    """Words of slices of a batch (lang, text), their codes, the languages and each word's language."""
    for start, stop in text_slices(batch, "text", size=_SLICE):
        part = batch.slice(start, stop - start)
        words = Words(*utf8(part.column("text")), GAP, BREAKS, seed)
        kinds = part.column("lang").dictionary_encode()
        names = kinds.dictionary.to_pylist()
        salts = [int.from_bytes(blake2b(x.encode(), digest_size=8, key=str(seed).encode()).digest(), "little") for x in names]
        of_word = np.repeat(kinds.indices.to_numpy(), np.diff(words.where))
        codes = joint([np.array(salts, np.uint64)[of_word], words.code]) if len(words) else words.code
        yield words, codes, names, of_word


def _vocabulary(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """(code, lang, word, n) of the words of each slice."""
    for batch in batches:
        for words, codes, names, kinds in _coded(batch, seed):
            distinct, first, n = np.unique(codes, return_index=True, return_counts=True)
            lang = pa.array(names, pa.string()).take(pa.array(kinds[first]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(distinct.astype(np.int64)), lang, words.texts(first), pa.array(n.astype(np.int64))],
                ["code", "lang", "word", "n"],
            )


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key is in sorted keys, and whether it is there."""
    place = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return place, keys[place] == wanted if len(keys) else np.zeros(len(wanted), bool)


@dataclass
class Ranked:
    """Ids of the most frequent words or phrases of one length.

    `keys` are sorted codes (words) or pairs of ids of the round before, `ids`
    belong to them, `words` has the word ids of each id.  `rest` tells what may
    be frequent without an id (None: nothing is).
    """

    keys: np.ndarray
    ids: np.ndarray
    words: np.ndarray
    rest: BitTable | None
    hot: int = 0

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        place, held = _found(self.keys, keys)
        return np.where(held, self.ids[place] if len(self.ids) else NONE, NONE)


def _ranks(group: np.ndarray, n: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, int]:
    """Ids by falling frequency, apart for each group, so that tiles hold what occurs together.

    The first TILE ids of every large group come first of all, a tile each;
    there are `hot` ids in these.
    """
    order = np.lexsort((tie, -n, group))
    _, start, sizes = np.unique(group[order], return_index=True, return_counts=True)
    nth = np.arange(len(order)) - np.repeat(start, sizes)
    large = sizes >= TILE
    hot = int(large.sum()) * TILE
    first = np.repeat((np.cumsum(large) - 1) * TILE, sizes)
    after = np.where(large, -(-(sizes - TILE) // TILE) * TILE, sizes)  # large groups end with whole tiles
    after = after[np.argsort(~large, kind="stable")]
    begin = np.empty(len(sizes), np.int64)
    begin[np.argsort(~large, kind="stable")] = hot + np.cumsum(after) - after
    later = np.repeat(begin, sizes) + nth - np.where(np.repeat(large, sizes), TILE, 0)
    ids = np.empty(len(order), np.int64)
    ids[order] = np.where(np.repeat(large, sizes) & (nth < TILE), first + nth, later)
    return ids, hot


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)


def _sequence(batch: pa.RecordBatch, seed: int, words: Ranked) -> Iterator[np.ndarray]:
    """Word ids of each slice, with NONE for infrequent words and between pieces."""
    for found, codes, _, _ in _coded(batch, seed):
        ids = words.look_up(codes)
        if words.rest is not None:
            other = np.flatnonzero(ids == NONE)
            other = other[words.rest.holds(codes[other])]
            ids[other] = -2 - codes[other].astype(np.int64)
        border = np.ones(len(ids), bool)
        owner = found.owner()
        border[:-1] = (found.part[1:] != found.part[:-1]) | (owner[1:] != owner[:-1])
        out = np.full(2 * len(ids), NONE)
        out[0::2] = ids
        kept = np.ones(len(out), bool)
        kept[1::2] = border
        out = out[kept]
        more = np.ones(len(out), bool)
        more[1:] = (out[1:] != NONE) | (out[:-1] != NONE)
        yield out[more]


def _looked_up(table: Ranked, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ids of pairs of ids of the round before, where both have one."""
    out = np.full(len(left), NONE)
    both = np.flatnonzero((left >= 0) & (right >= 0))
    out[both] = table.look_up(_pair(left[both], right[both]))
    return out


def _raised(ids: np.ndarray, symbols: np.ndarray, length: int, table: Ranked) -> np.ndarray:
    """Ids of the phrases of `length` words at each place, from the ids of phrases one word shorter."""
    left, right = ids[:-1], ids[1:]
    out = _looked_up(table, left, right)
    if table.rest is not None:
        other = np.flatnonzero((out == NONE) & (left != NONE) & (right != NONE))
        held = table.rest.holds(joint(symbols[other + k] for k in range(length)))
        out[other[held]] = NONE - 1
    return out


def _tiled(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left, right, n) of pairs of ids, tile by tile."""
    if not len(left):
        return
    tile = _pair(left // TILE, right // TILE)
    order = np.argsort(tile, kind="stable")
    left, right, tile = left[order], right[order], tile[order]
    edges = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1], [True])))
    dense = np.diff(edges) >= DENSE
    for first, last in zip(edges[:-1][dense].tolist(), edges[1:][dense].tolist(), strict=True):
        a, b = left[first] // TILE * TILE, right[first] // TILE * TILE
        counts = np.bincount((left[first:last] - a) * TILE + right[first:last] - b, minlength=TILE * TILE)
        cells = np.flatnonzero(counts)
        yield a + cells // TILE, b + cells % TILE, counts[cells]
    sparse = np.repeat(~dense, np.diff(edges))
    pairs, counts = np.unique(_pair(left[sparse], right[sparse]), return_counts=True)
    yield (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), counts


def _gathered(symbols: np.ndarray, tables: list[Ranked]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases one word longer than the last table's: their word ids, row by row, and how often each occurs."""
    ids = symbols
    for length, table in enumerate(tables[1:], 2):
        ids = _raised(ids, symbols, length, table)
    size, words = len(tables) + 1, tables[-1].words
    left, right = ids[:-1], ids[1:]
    known = (left >= 0) & (right >= 0)
    for a, b, n in _tiled(left[known], right[known]):
        yield np.column_stack((words[a], words[b][:, -1])), n
    at = np.flatnonzero((left != NONE) & (right != NONE) & ~known)
    if len(at):
        rows = np.column_stack([symbols[at + k] for k in range(size)])
        rows = rows[np.lexsort(rows.T)]
        fresh = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1))))
        yield rows[fresh], np.diff(np.append(fresh, len(rows)))


def _phrases(batches: Iterator[pa.RecordBatch], seed: int, sent: list) -> Iterator[pa.RecordBatch]:
    """(w1, w2, ..., n): phrases one word longer than the last of the tables, with their counts in a part of the texts."""
    tables = [x.value for x in sent]
    names = [f"w{k + 1}" for k in range(len(tables) + 1)]

    def counted(parts):
        for rows, n in _gathered(np.concatenate(parts), tables):
            for start in range(0, len(n), _ROWS):
                piece = rows[start : start + _ROWS]
                columns = [pa.array(np.ascontiguousarray(piece[:, k])) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n[start : start + _ROWS].astype(np.int64))], [*names, "n"])

    held, size = [], 0
    for batch in batches:
        for sequence in _sequence(batch, seed, tables[0]):
            held.append(sequence)
            size += len(sequence)
            if size >= _TOGETHER:
                yield from counted(held)
                held, size = [], 0
    if size > len(tables):
        yield from counted(held)


def _head(grams: DataFrame, columns: list[Column], total: int, head: int) -> list[np.ndarray]:
    """Columns of the `head` most frequent rows, as arrays."""
    best = grams if total <= head else grams.orderBy(F.desc("n"), *grams.columns).limit(head)
    table = best.select(*columns).toArrow()
    return [table.column(i).to_numpy() for i in range(table.num_columns)]


def _ranked_words(words: DataFrame, head: int) -> Ranked:
    total = words.count()
    code, lang, n = _head(words, [F.col("code"), F.xxhash64("lang"), F.col("n")], total, head)
    ids, hot = _ranks(lang, n, code)
    order = np.argsort(code)
    width = int(ids.max(initial=-1)) + 1
    rest = BitTable.of(words, "code", total) if total > head else None
    return Ranked(code[order].astype(np.uint64), ids[order], np.arange(width)[:, None], rest, hot)


def _ranked_phrases(grams: DataFrame, tables: list[Ranked], head: int) -> Ranked:
    """Ids of phrases, from the ids of their beginnings and ends in the tables before."""
    size = len(tables) + 1
    names = [f"w{k + 1}" for k in range(size)]
    total = grams.count()
    *found, n = _head(grams, [F.col(c) for c in [*names, "n"]], total, head)
    rows = np.column_stack(found) if len(n) else np.zeros((0, size), np.int64)

    ids = rows
    for table in tables[1:]:
        ids = np.column_stack([_looked_up(table, ids[:, k], ids[:, k + 1]) for k in range(ids.shape[1] - 1)])
    left, right = ids[:, 0], ids[:, 1]
    known = (left >= 0) & (right >= 0)
    rows, n, left, right = rows[known], n[known], left[known], right[known]
    # a language's words lie in ranges of ids; what begins with them belongs together
    group = rows[:, 0] // TILE if len(rows) else np.zeros(0, np.int64)
    ids, _ = _ranks(np.where(rows[:, 0] < tables[0].hot, group, -1) if len(rows) else group, n, _pair(left, right))
    keys = _pair(left, right)
    order = np.argsort(keys)
    words = np.zeros((int(ids.max(initial=-1)) + 1, size), np.int64)
    words[ids] = rows
    rest = None
    if total > head or any(t.rest is not None for t in tables):
        rest = BitTable.of(_with_codes(grams, names), "code", total)
    return Ranked(keys[order], ids[order], words, rest)


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = joint(c.to_numpy() for c in batch.columns)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64))], ["code"])


def _with_codes(grams: DataFrame, names: list[str]) -> DataFrame:
    return grams.select(*names).mapInArrow(_codes, "code bigint")


def _words(texts: DataFrame, least: int) -> tuple[int, DataFrame, DataFrame]:
    """The seed under which no two words share a code, the frequent words and the size of each language."""
    for seed in range(_SEEDS):
        counted = texts.mapInArrow(partial(_vocabulary, seed=seed), "code bigint, lang string, word string, n bigint")
        one = F.struct("lang", "word")
        words = keep(counted.groupBy("code").agg(F.sum("n").alias("n"), F.min(one).alias("own"), F.max(one).alias("other")), "words")
        if words.where("own <> other").isEmpty():
            sizes = words.groupBy("own.lang").agg(F.sum("n").alias("total"))
            return seed, words.where(F.col("n") >= least).select("code", "own.lang", "own.word", "n"), sizes
    raise RuntimeError(f"words share codes under each of {_SEEDS} seeds")


def _named(words: DataFrame, ranked: Ranked) -> DataFrame:
    """(id, lang, word, n) of all frequent words; what got no rank is known by its code."""
    spark = words.sparkSession
    table = pa.table({"code": pa.array(ranked.keys.astype(np.int64)), "id": pa.array(ranked.ids)})
    ids = spark.createDataFrame(table) if len(ranked.ids) else spark.createDataFrame([], "code bigint, id bigint")
    return keep(words.join(ids, "code", "left").select(F.coalesce("id", F.lit(-2) - F.col("code")).alias("id"), "lang", "word", "n"), "ids")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, absorbed: int = 80, head: int = HEAD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) for the `top` phrases of each language of `docs` (lang, text).

    Texts are cut into pieces and these into words, A-Z in lower case; a null
    language is `und`, a null text empty.  Candidates are phrases of 2 to
    `longest` words that occur at least `least` times (a); n is the number of
    words of the language.  Of the cuts of a candidate in two, with counts l and
    r, the one with the lowest floor(2000000 a / (l + r)) gives the score, on
    ties that with the shortest first part.  A candidate inside a longer one
    that has at least `absorbed` percent of its occurrences is dropped.  Ranks
    go by score, count and phrase (in byte order), so that there are no ties.
    Repeated rows count as often as they occur; no rows give no rows.
    """
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    texts = docs.select(lang.alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    seed, words, sizes = _words(texts, least)
    tables = [_ranked_words(words, head)]
    named = _named(words, tables[0])
    counts = [named.select(F.col("id").alias("w1"), "n")]
    sent = [spark.sparkContext.broadcast(tables[0])]
    for size in range(2, longest + 1):
        names = [f"w{k + 1}" for k in range(size)]
        schema = ", ".join(f"{c} bigint" for c in [*names, "n"])
        found = texts.mapInArrow(partial(_phrases, seed=seed, sent=sent), schema)
        grams = keep(found.groupBy(*names).agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases")
        if grams.isEmpty():
            break
        counts.append(grams)
        if size < longest:
            tables.append(_ranked_phrases(grams, tables, head))
            sent.append(spark.sparkContext.broadcast(tables[-1]))
    scored = _scored(counts, tables[0].hot, absorbed)
    phrases = _spelled(scored, named, tables[0].hot)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = phrases.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _salted(table: DataFrame, key: Column, single: Column, hot: int) -> DataFrame:
    """With a column that deals the rows of a very frequent word to several tasks."""
    return table.withColumn("salt", F.when(single.between(0, hot - 1), F.pmod(F.xxhash64(key), F.lit(_SALTS))).otherwise(F.lit(0)).cast("int"))


def _copied(table: DataFrame, single: Column, hot: int) -> DataFrame:
    """The other side of such a join: one row for every salt."""
    every = F.when(single.between(0, hot - 1), F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))
    return table.withColumn("salt", F.explode(every))


def _scored(counts: list[DataFrame], hot: int, absorbed: int) -> DataFrame:
    """(key, a, l, r, score) of the candidates that stay; a key is an array of word ids."""
    keyed = [c.select(F.array(*c.columns[:-1]).alias("key"), "n") for c in counts]
    every = keyed[0]
    for table in keyed[1:]:
        every = every.union(table)
    alone = lambda c: F.when(F.size(c) == 1, F.get(c, 0)).otherwise(F.lit(NONE))
    known = _copied(every, alone(F.col("key")), hot)
    part = lambda name: known.select(F.col("key").alias(name), F.col("n").alias(name[0]), "salt")
    candidates = every.where(F.size("key") > 1).select("key", F.col("n").alias("a"))
    cuts = candidates.select("key", "a", F.explode(F.sequence(F.lit(1), F.size("key") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("key", F.lit(1), F.col("k")).alias("left"), F.slice("key", F.col("k") + 1, F.size("key") - F.col("k")).alias("right"))
    for name in ("left", "right"):
        cuts = _salted(cuts, F.col("key"), alone(F.col(name)), hot).join(part(name), [name, "salt"]).drop(name, "salt")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    both = wide("l") + wide("r")
    score = F.floor((F.lit(2_000_000).cast("decimal(7,0)") * wide("a") - (F.lit(2_000_000).cast("decimal(7,0)") * wide("a")) % both) / both)
    cuts = cuts.select("key", "a", F.struct(score.cast("long").alias("score"), "k", "l", "r").alias("cut"))
    best = cuts.groupBy("key").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))
    inner = F.expr(
        "flatten(transform(sequence(2, size(key) - 1), m -> transform(sequence(1, size(key) - m + 1), i -> slice(key, i, m))))"
    )
    longer = candidates.where(F.size("key") > 2).select(F.explode(inner).alias("key"), "a").groupBy("key").agg(F.max("a").alias("most"))
    covered = wide("most") * 100 >= wide("a") * absorbed
    return best.join(longer, "key", "left").where(~F.coalesce(covered, F.lit(False))).select("key", "a", "cut.l", "cut.r", "cut.score")


def _spelled(scored: DataFrame, named: DataFrame, hot: int) -> DataFrame:
    """With the language and the words instead of ids."""
    words = _copied(named.select("id", "lang", "word"), F.col("id"), hot)
    places = scored.select("key", F.posexplode("key").alias("place", "id"))
    spelled = _salted(places, F.col("key"), F.col("id"), hot).join(words, ["id", "salt"])
    whole = spelled.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("words"), F.min("lang").alias("lang"))
    return scored.join(whole, "key").withColumn("phrase", F.array_join("words.word", " ")).drop("key", "words")
