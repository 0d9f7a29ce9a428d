"""Near-duplicate documents by bottom-k sketches of one hash function.

Every document becomes the set of its word shingles; its sketch is the `k`
smallest hash values of that set.  Equal sets are one class from the start.
Inverted lists of the retained values give the candidates: two sets at the
threshold share at least `overlap` retained values (but for one pair in a
million), so with values ordered from rare to common they meet in a list of
one of their first k - overlap + 1 values.  Sets that are in a list at all get
lists of their whole sets, in the same way and without chance: a set with more
values of its own than the threshold allows is in none.  A pair that could not
reach the threshold even if it shared every value that another set has as well
is no candidate; a candidate must pass the estimate from the union's sketch, and
is then compared on full sets.

Only what connects matters, so the lists are not expanded into pairs: in each
turn the members of a list are compared with one leader of the list, at first
the one with the fewest values of its own, and lists whose members are all
connected are done.  What is still apart after these
turns is compared pair by pair, across components only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsieve.llm.arrays import mix, ragged, shingle_hashes, text_slices, utf8, word_hashes
from credsieve.llm.components import components
from credsieve.session import keep

RETAINED = 32
MISSED = 1e-6
STAR_TURNS = 5
_REMEMBERED_LISTS = 32
BROADCAST_ROWS = 500_000


def least_overlap(retained: int, percent: int) -> int:
    """The number of shared values in a union's sketch that a pair at the threshold reaches but for MISSED."""
    share, tail, count = percent / 100, 0.0, 0
    while count < retained:
        tail += comb(retained, count) * share**count * (1 - share) ** (retained - count)
        if tail > MISSED:
            break
        count += 1
    return count


def _sketched(batches: Iterator[pa.RecordBatch], shingle: int, retained: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop in text_slices(batch, "text"):
            part = batch.slice(start, stop - start)
            codes, where = shingle_hashes(*word_hashes(*utf8(part.column("text"))), shingle)
            sizes = np.diff(where)
            sums = []
            for seed in (0x1D8E4E27C47D124F, 0x2B5A5E8B7F4A3C91):
                running = np.concatenate(([np.uint64(0)], np.cumsum(mix(codes.astype(np.uint64) ^ np.uint64(seed)))))
                sums.append((running[where[1:]] - running[where[:-1]]).view(np.int64))
            held = np.minimum(sizes, retained)
            edges = np.concatenate(([0], np.cumsum(held)))
            taken = np.arange(edges[-1]) + np.repeat(where[:-1] - edges[:-1], held)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(sizes), pa.array(sums[0]), pa.array(sums[1]), ragged(codes[taken], edges)],
                ["id", "n", "s1", "s2", "sketch"],
            )


def _whole_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop in text_slices(batch, "text"):
            part = batch.slice(start, stop - start)
            codes, where = shingle_hashes(*word_hashes(*utf8(part.column("text"))), shingle)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(np.diff(where)), ragged(codes, where)], ["id", "n", "codes"]
            )


def _can_reach(percent: int) -> Column:
    """Whether a pair could reach the threshold if it shared all that other sets have at all of the one with less of it."""
    most = F.least(F.col("n_a") - F.col("alone_a"), F.col("n_b") - F.col("alone_b"))
    return most * 100 >= (F.col("n_a") + F.col("n_b") - most) * percent


def _alike(pairs: DataFrame, reps: DataFrame, retained: int, overlap: int) -> DataFrame:
    """Pairs (a, b) whose union's sketch shares enough values."""
    side = lambda x: reps.select(F.col("id").alias(x), F.col("sketch").alias(f"s_{x}"))
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, retained)
    shared = F.size(F.array_intersect(union, F.array_intersect("s_a", "s_b")))
    met = shared * retained >= F.size(union) * overlap
    return pairs.join(side("a"), "a").join(side("b"), "b").where(met).select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that reach the threshold on their full sets."""
    side = lambda x: sets.select(
        F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("codes").alias(f"c_{x}")
    )
    both = F.size(F.array_intersect("c_a", "c_b")).cast("long")
    reached = both * 100 >= (F.col("n_a") + F.col("n_b") - both) * percent
    return pairs.join(side("b"), "b").join(side("a"), "a").where(reached).select("a", "b")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, retained: int = RETAINED, star_turns: int = STAR_TURNS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document of `docs` (doc_id, text).

    Documents are linked if 100 * intersection >= percent * union of their sets
    of `shingle`-word shingles; a component is what links connect, named by its
    smallest doc_id, the one that is kept.  A null or wordless text has an
    empty set and is linked with nothing; fewer words than a shingle make one
    shingle.  Rows that repeat a doc_id are one document, that with the
    smallest set.  Each row without doc_id is kept by itself, with a null
    component.  An empty table gives no rows; other columns are not read.
    """
    overlap = least_overlap(retained, percent)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    schema = "id bigint, n bigint, s1 bigint, s2 bigint, sketch array<bigint>"
    sketched = keep(texts.mapInArrow(partial(_sketched, shingle=shingle, retained=retained), schema), "sketches")
    first = F.row_number().over(Window.partitionBy("id").orderBy("n", "s1", "s2"))
    named = sketched.where("id is not null").withColumn("copy", first).where("copy = 1").drop("copy")
    classes = named.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"))
    members = keep(named.join(classes, ["n", "s1", "s2"], "left").select(
        "id", "n", F.coalesce("rep", "id").alias("rep"), F.when(F.col("id") == F.col("rep"), F.col("sketch")).alias("sketch")
    ), "members")
    reps = members.where("sketch is not null").select("id", "n", "sketch")
    labels = _labels(texts, reps, shingle, percent, retained, overlap, star_turns)
    found = members.select("id", "n", "rep").join(labels, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep")
    whole = found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )
    unnamed = sketched.where("id is null").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("kept")
    )
    return whole.union(unnamed)


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay, with the columns they came with: one document of each group.

    Of several rows with one doc_id, that with the smallest hash stays; rows
    without doc_id all stay.
    """
    found = near_duplicates(docs.select("doc_id", "text"), shingle, percent)
    gone = keep(found.where("not kept").select("doc_id"), "gone")
    often = keep(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeats")
    once = docs.join(_bounded(gone.union(often)), "doc_id", "left_anti")
    rows = docs.join(_bounded(often), "doc_id", "left_semi").join(_bounded(gone), "doc_id", "left_anti")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    first = F.row_number().over(Window.partitionBy("row.doc_id").orderBy(F.xxhash64("row")))
    rest = rows.select(whole).select("row", first.alias("copy")).where("copy = 1").select("row.*")
    return once.select(*(F.col(f"`{c}`") for c in docs.columns)).union(rest)


def _bounded(ids: DataFrame) -> DataFrame:
    """Ids to look up: sent to all tasks up to BROADCAST_ROWS of 8 bytes each, else joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _listed(rows: DataFrame, values: str, least: Column) -> DataFrame:
    """The inverted lists (value, id, alone, at) of the sets in column `values` of `rows` (id, n).

    `least` is how many values a set must share with another one to be linked.
    Values are ordered from rare to common, so that two linked sets share one
    of the first size - least + 1 of each; `alone` values that no other set has
    come first and need no list.  `at` is the value's number in that order.
    """
    postings = rows.select("id", F.size(values).alias("size"), least.cast("int").alias("least"), F.explode(values).alias("value"))
    frequency = postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("id")
    shared = postings.join(frequency, "value").select(
        "id", "value", "size", "least", F.row_number().over(own.orderBy("df", "value")).alias("nth"),
        (F.col("size") - F.count("*").over(own)).alias("alone"),
    )
    return shared.withColumn("at", F.col("alone") + F.col("nth")).where("at <= size - least + 1").select("value", "id", "alone", "at")


def _apart_pairs(left: DataFrame, percent: int) -> DataFrame:
    """Pairs of the members of lists (value, id, n, alone, at, own) that differ in `own`.

    A pair comes from the first list that it shares: the values before it are
    not shared, which bounds what can be shared at all.  (Beyond
    _REMEMBERED_LISTS lists, a pair may come more than once.)
    """
    before = Window.partitionBy("id").orderBy("at").rowsBetween(-_REMEMBERED_LISTS, -1)
    known = left.withColumn("earlier", F.collect_list("value").over(before))
    names = ("id", "n", "alone", "own", "at", "earlier")
    side = lambda x: known.select("value", *(F.col(c).alias(f"{c}_{x}") for c in names))
    most = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + 1
    enough = most * 100 >= (F.col("n_a") + F.col("n_b") - most) * percent
    first = F.size(F.array_intersect("earlier_a", "earlier_b")) == 0
    met = side("a").join(side("b"), "value").where((F.col("id_a") < F.col("id_b")) & (F.col("own_a") != F.col("own_b")) & enough & first)
    return met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "n_a", "n_b", "alone_a", "alone_b")


def _labels(
    texts: DataFrame, reps: DataFrame, shingle: int, percent: int, retained: int, overlap: int, star_turns: int
) -> DataFrame:
    rough = _listed(reps, "sketch", F.ceil(F.size("sketch") * overlap / retained))
    whole = texts.join(_bounded(keep(rough.select("id").distinct(), "candidates")), "id", "left_semi").mapInArrow(
        partial(_whole_sets, shingle=shingle), "id bigint, n bigint, codes array<bigint>"
    )
    sets = keep(reps.select("id", "n").join(whole, ["id", "n"]).dropDuplicates(["id"]), "sets")
    fine = _listed(sets, "codes", F.ceil(F.col("n") * percent / 100))
    lists = keep(fine.join(sets.select("id", "n"), "id"), "lists")
    labels = reps.select(F.col("id").alias("node"), F.col("id").alias("component")).limit(0)
    links = None
    for turn in range(star_turns + 1):
        now = lists.join(labels, F.col("id") == F.col("node"), "left").select(
            "value", "id", "n", "alone", "at", F.coalesce("component", "id").alias("own")
        )
        apart = now.groupBy("value").agg(
            F.min("own").alias("low"), F.max("own").alias("high"),
            F.min_by(F.struct("id", "n", "alone", "own"), F.xxhash64("id", F.lit(turn)) if turn else F.struct("alone", "id")).alias("lead"),
        ).where("low < high").select("value", "lead")
        if turn < star_turns:
            near = now.join(apart, "value").where("own <> lead.own").select(
                F.col("lead.id").alias("a"), F.col("id").alias("b"), F.col("lead.n").alias("n_a"), F.col("n").alias("n_b"),
                F.col("lead.alone").alias("alone_a"), F.col("alone").alias("alone_b"),
            )
        else:
            near = _apart_pairs(now.join(apart.select("value"), "value", "left_semi"), percent)
        pairs = near.where(_can_reach(percent)).select("a", "b").distinct()
        fresh = keep(_linked(_alike(pairs, reps, retained, overlap), sets, percent), "near")
        if fresh.isEmpty():
            if turn >= star_turns or apart.isEmpty():
                break
            continue
        links = fresh if links is None else links.union(fresh)
        labels = components(links)
    return labels
