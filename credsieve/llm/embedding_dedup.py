"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation learned on a bounded sample turns every unit vector into a balanced
binary code, the signs of its rotated components.  The code is cut into several
parts, each with its own table of buckets.  Two vectors that link are close, so
the components in which their signs differ are small: their squares add up to
no more than the squared distance.  So in at least one table the smaller of
both sums over the differing bits stays below half that table's share, and the
vector with that sum finds the other one by flipping such bits of its own part.
No link is missed, and none depends on chance.

Buckets are compared in blocks with the original vectors in double precision;
each pair counts in one bucket only, and what leaves a block are counts of
links and the edges of a spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credsieve.llm.components import components
from credsieve.llm.vectors import stacked, usable
from credsieve.session import keep

COSINE = 0.98
SAMPLE = 20_000
BITS = 64
BLOCK = 4096
_TILE = 1024
_SLACK = 1e-9


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = 30, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal directions turned so that signs lose as little as possible."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    values, vectors = np.linalg.eigh(centred.T @ centred)
    principal = vectors[:, np.argsort(-values)[:bits]]
    reduced = centred @ principal
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((principal.shape[1],) * 2))
    for _ in range(rounds):
        signs = np.where(reduced @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ reduced)
        turn = (left @ right).T
    return mean, principal @ turn


class Tables:
    """Codes and buckets of vectors under one learned rotation."""

    def __init__(self, mean: np.ndarray, projection: np.ndarray, count: int, cosine: float):
        self.mean, self.projection, bits = mean, projection, projection.shape[1]
        # parts of about log2(count) bits, as many buckets as vectors
        self.parts = np.array_split(np.arange(bits), max(1, min(bits, round(bits / max(log2(max(count, 2)), 1)))))
        self.limit = (2 - 2 * cosine) / len(self.parts) / 2 + _SLACK

    def rotated(self, units: np.ndarray) -> np.ndarray:
        return (units - self.mean) @ self.projection

    def buckets(self, rotated: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(table, rows, codes, whether the code is the row's own) for own and flipped codes."""
        for table, part in enumerate(self.parts):
            value = rotated[:, part]
            weights = np.int64(1) << np.arange(len(part), dtype=np.int64)
            own = (value >= 0) @ weights
            rows, codes = np.arange(len(own)), own
            energy, after = np.zeros(len(own)), np.zeros(len(own), np.int64)
            yield table, rows, codes, np.ones(len(rows), bool)
            squares = value**2
            while len(rows):
                # one more flip, further right than the last one
                free = np.arange(len(part))[None, :] >= after[:, None]
                total = energy[:, None] + squares[rows]
                which, bit = np.nonzero(free & (total <= self.limit))
                rows, codes, energy, after = rows[which], codes[which] ^ weights[bit], total[which, bit], bit + 1
                if len(rows):
                    yield table, rows, codes, np.zeros(len(rows), bool)


def _units(batch: pa.RecordBatch | pa.Table, width: int) -> np.ndarray:
    raw = stacked(batch.column("vector"), width)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.T


def _met_before(tables: Tables, table: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rotated rows a and b: whether they meet in an earlier table; energy of a's differing bits in this one."""
    before = np.zeros((len(a), len(b)), bool)
    for number, part in enumerate(tables.parts[: table + 1]):
        x, y = a[:, part], b[:, part]
        sign_x, sign_y = np.where(x >= 0, 1.0, -1.0), np.where(y >= 0, 1.0, -1.0)
        from_x = ((x**2).sum(axis=1)[:, None] - (x**2 * sign_x) @ sign_y.T) / 2
        if number == table:
            return before, from_x
        from_y = ((y**2).sum(axis=1)[None, :] - sign_x @ (y**2 * sign_y).T) / 2
        before |= np.minimum(from_x, from_y) <= tables.limit
    raise AssertionError


def _forest(linked: np.ndarray, home: np.ndarray, visiting: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the true cells of a matrix (home rows, visiting columns) connect."""
    ids, place = np.unique(np.concatenate([home, visiting]), return_inverse=True)
    rows, columns = place[: len(home)], place[len(home) :]
    label = np.arange(len(ids))
    while True:
        old = label.copy()
        low = np.where(linked, label[columns][None, :], len(ids)).min(axis=1)
        np.minimum.at(label, rows, low)
        low = np.where(linked, label[rows][:, None], len(ids)).min(axis=0)
        np.minimum.at(label, columns, low)
        if (label == old).all():
            break
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return list(zip(ids[moved].tolist(), ids[label[moved]].tolist(), strict=True))


def _compared(tables: Tables, cosine: float, table: int, home: tuple, visiting: tuple) -> tuple[list, list]:
    """Counts (id, links) and edges between home rows and the visitors of one bucket.

    Sides are (ids, weights, unit vectors, whether at home).  A pair that meets
    in several buckets counts in the earliest table; within a table, where both
    are at home, or else, if both find each other, in the smaller id's bucket.
    """
    counts, edges = [], []
    for i in range(0, len(home[0]), _TILE):
        a, a_weight, a_unit, _ = (x[i : i + _TILE] for x in home)
        a_turned = tables.rotated(a_unit)
        for j in range(0, len(visiting[0]), _TILE):
            b, b_weight, b_unit, b_home = (x[j : j + _TILE] for x in visiting)
            linked = _cosines(a_unit, b_unit) >= cosine
            linked &= np.where(b_home[None, :], a[:, None] < b[None, :], a[:, None] != b[None, :])
            if not linked.any():
                continue
            before, energy = _met_before(tables, table, a_turned, tables.rotated(b_unit))
            elsewhere = ~b_home[None, :] & (energy <= tables.limit) & (a[:, None] > b[None, :])
            linked &= ~(before | elsewhere)
            for ids, links in ((a, linked @ b_weight), (b, a_weight @ linked)):
                some = links > 0
                counts += zip(ids[some].tolist(), links[some].tolist(), strict=True)
            edges += _forest(linked, a, b)
    return counts, edges


def near_duplicates(
    table: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, bits: int = BITS, block: int = BLOCK
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vector of `table` (vec_id, embedding, label).

    Vectors with equal labels are linked if their cosine is at least `cosine`.
    Null labels link with nothing, nor do vectors that are null, zero or hold
    null or non-finite components; shorter vectors count as filled up with
    zeros.  Rows that repeat a vec_id are one vector, that with the smallest
    hash.  Each row without vec_id is kept by itself with a null component.
    An empty table gives no rows; other columns are not read.
    """
    vectors = table.select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("vector", "label")))
    named = vectors.where("id is not null").withColumn("copy", first).where("copy = 1").drop("copy")
    valid = named.where(F.col("label").isNotNull() & usable("vector"))
    keyed = valid.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector"))
    same = ["label", "h1", "h2"]
    classes = keep(keyed.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("weight")), "classes")
    members = keep(keyed.join(classes, same).select("id", "rep", "weight", "label", "vector"), "members")
    reps = members.where("id = rep").drop("rep")
    links, edges = _links(reps, cosine, sample, bits, block)
    # a zero default keeps what has no link; equal vectors link with each other
    found = members.select("id", "rep", "weight").join(links, members["rep"] == links["link_id"], "left")
    labelled = found.join(components(edges), F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep")
    linked = labelled.select(
        F.col("id").alias("vec_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        component.alias("component_id"), (F.col("id") == component).alias("kept"),
    )
    alone = lambda rows: rows.select(
        F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")
    )
    rest = named.where(~(F.col("label").isNotNull() & usable("vector")))
    return linked.union(alone(rest)).union(alone(vectors.where("id is null")))


def _links(reps: DataFrame, cosine: float, sample: int, bits: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(link_id, links) and edges (a, b) among distinct vectors."""
    spark = reps.sparkSession
    count, width = reps.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not count:
        return spark.createDataFrame([], "link_id bigint, links bigint"), spark.createDataFrame([], "a bigint, b bigint")
    drawn = reps.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()
    tables = Tables(*learn_rotation(_units(drawn, width), min(bits, width)), count, cosine)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                ids, labels = part.column("id").to_numpy(), part.column("label")
                for number, rows, codes, home in tables.buckets(tables.rotated(_units(part, width))):
                    yield pa.RecordBatch.from_arrays(
                        [labels.take(pa.array(rows)), pa.array(np.full(len(rows), number, np.int32)), pa.array(codes),
                         pa.array(ids[rows]), pa.array(home)], ["label", "part", "code", "id", "home"]
                    )

    key = ["label", "part", "code"]
    placed = keep(reps.select("id", "label", "vector").mapInArrow(coded, "label string, part int, code bigint, id bigint, home boolean"), "codes")
    sizes = placed.groupBy(*key).agg(F.count_if("home").alias("at_home"), F.count("*").alias("n")).where("at_home > 0 and n > 1")
    # a crowded bucket is cut into blocks, and every block of home rows meets every block of all rows
    crowd = placed.join(sizes, key).withColumn("h", F.ceil(F.col("at_home") / block)).withColumn("v", F.ceil(F.col("n") / block))
    own = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.col(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    at_home = crowd.where("home").withColumn("i", own("h", 1)).withColumn("j", spread("v")).withColumn("visits", F.lit(False))
    visits = crowd.withColumn("j", own("v", 2)).withColumn("i", spread("h")).withColumn("visits", F.lit(True))
    cells = [*key, "i", "j"]
    sides = at_home.unionByName(visits).select(*cells, "visits", "id", "home").join(reps.select("id", "weight", "vector"), "id")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _runs(batches, cells):
            visiting = cell.column("visits").to_numpy(zero_copy_only=False)
            ids, weights = cell.column("id").to_numpy(), cell.column("weight").to_numpy()
            home, units = cell.column("home").to_numpy(zero_copy_only=False), _units(cell, width)
            sides = [tuple(x[mask] for x in (ids, weights, units, home)) for mask in (~visiting, visiting)]
            counts, edges = _compared(tables, cosine, cell.column("part")[0].as_py(), *sides)
            if counts or edges:
                a, b = zip(*counts, *edges, strict=True)
                kind = pa.array([True] * len(counts) + [False] * len(edges))
                yield pa.RecordBatch.from_arrays([kind, pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["counts", "a", "b"])

    together = sides.repartition(*cells).sortWithinPartitions(*cells)
    found = keep(together.mapInArrow(compared, "counts boolean, a bigint, b bigint"), "links")
    links = found.where("counts").groupBy(F.col("a").alias("link_id")).agg(F.sum("b").alias("links"))
    return links, found.where("not counts").select("a", "b")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        new = np.zeros(batch.num_rows, bool)
        if held and batch.num_rows:
            new[0] = any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys)
        for k in keys:
            column = batch.column(k)
            new[1:] |= pa.compute.not_equal(column.slice(1), column.slice(0, max(batch.num_rows - 1, 0))).to_numpy(zero_copy_only=False)
        start = 0
        for cut in np.flatnonzero(new).tolist():
            if cut > start:
                held.append(batch.slice(start, cut - start))
            if held:
                yield pa.Table.from_batches(held)
            held, start = [], cut
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
