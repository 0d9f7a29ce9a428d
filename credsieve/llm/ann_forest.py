"""Nearest neighbours by inner product, from a forest of random-projection trees.

The trees split the space by the halves between two sampled vectors; they are
built on a bounded sample and every row is sent down all of them.  To rank by
inner product, vectors get one more component that brings them all to the same
length.  A query goes through one priority queue that all trees share: the
branch whose worst margin on the way is best comes next, until a share of all
leaves is reached and these hold many times the rows that are asked for; a small
table is searched as a whole.  What lies in these leaves is ranked by the exact
product.

The index is sharded: a task holds a block of rows with their leaves and ranks
candidates for a block of queries; the best of each block are merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsieve.llm.vectors import stacked, usable
from credsieve.session import keep

SAMPLE = 50_000
TREES = 8
LEAVES = 256
LEAF_SHARE = 0.2
NEIGHBOURS = 20
#: The leaves that a query reaches hold at least so many times the rows it asks for, if there are as many.
ENOUGH = 10
ROWS_PER_SHARD = 8192
QUERIES_PER_BLOCK = 4096
_QUERIES_AT_ONCE = 256


@dataclass
class Tree:
    normals: np.ndarray
    middles: np.ndarray
    children: np.ndarray  # (inner nodes, 2); a leaf is -1 - its number
    leaves: int
    sizes: np.ndarray  # sampled points of each leaf

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        node = np.full(len(points), 0 if len(self.normals) else -1)
        while (inner := np.flatnonzero(node >= 0)).size:
            at = node[inner]
            right = np.einsum("ij,ij->i", points[inner], self.normals[at]) > self.middles[at]
            node[inner] = self.children[at, right.astype(int)]
        return -1 - node


def grow(points: np.ndarray, leaf: int, random: np.random.Generator) -> Tree:
    """One tree, split at medians until at most `leaf` sampled points are left or all are equal."""
    normals, middles, children, sizes = [], [], [], []
    todo = [(np.arange(len(points)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        name = -1 - len(sizes)
        if len(rows) > leaf:
            one, two = random.choice(rows, 2, replace=False)
            normal = points[one] - points[two]
            if not normal.any():
                normal = random.standard_normal(points.shape[1])
            place = points[rows] @ (normal / np.linalg.norm(normal))
            middle = np.median(place)
            right = place > middle
            if right.any():
                name = len(normals)
                normals.append(normal / np.linalg.norm(normal))
                middles.append(middle)
                children.append([0, 0])
                todo += [(rows[~right], name, 0), (rows[right], name, 1)]
        if name < 0:
            sizes.append(len(rows))
        if parent >= 0:
            children[parent][side] = name
    width = points.shape[1]
    links = np.array(children, int).reshape(-1, 2)
    return Tree(np.array(normals).reshape(-1, width), np.array(middles), links, len(sizes), np.array(sizes))


@dataclass
class Forest:
    trees: list[Tree]
    width: int
    longest: float  # length that every indexed vector is brought to

    def indexed(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (vectors**2).sum(axis=1), 0))
        return np.column_stack([vectors, rest])

    def asked(self, vectors: np.ndarray) -> np.ndarray:
        scale = self.longest / np.linalg.norm(vectors, axis=1)
        return np.column_stack([vectors * scale[:, None], np.zeros(len(vectors))])

    def reached(self, point: np.ndarray, share: float, least: int = 0) -> np.ndarray:
        """Numbers of the leaves (over all trees) that one query reaches.

        They are a share of all leaves, and more until those of one tree, which
        have no point in common, hold `least` sampled points, or none is left.
        """
        first = np.cumsum([0, *(t.leaves for t in self.trees)])
        margins = [(t.normals @ point - t.middles).tolist() for t in self.trees]
        queue = [(-np.inf, i, 0 if len(t.normals) else -1) for i, t in enumerate(self.trees)]
        found, wanted = [], ceil(share * first[-1])
        held = [0] * len(self.trees)
        while queue and (len(found) < wanted or max(held) < least):
            worst, i, node = heapq.heappop(queue)
            if node < 0:
                found.append(first[i] - 1 - node)
                held[i] += int(self.trees[i].sizes[-1 - node])
                continue
            left, right = self.trees[i].children[node].tolist()
            margin = margins[i][node]
            heapq.heappush(queue, (max(worst, margin), i, left))
            heapq.heappush(queue, (max(worst, -margin), i, right))
        return np.array(found, np.int32)


def fit(rows: DataFrame, sample: int = SAMPLE, trees: int = TREES, leaves: int = LEAVES, seed: int = 11) -> Forest | None:
    """A forest over at most `sample` rows (a documented bound), dealt by a hash of vec_id; None without rows.

    Each tree gets about `leaves` leaves, or as many as the sample allows.
    """
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    width, longest = rows.agg(F.max(F.size("vector")), F.max(length)).first()
    if not width:
        return None
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toArrow()
    forest = Forest([], width, longest)
    points = forest.indexed(stacked(drawn.column("vector"), width))
    random = np.random.default_rng(seed)
    forest.trees = [grow(points, max(8, ceil(len(points) / leaves)), random) for _ in range(trees)]
    return forest


def _block(name: str, size: int, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), F.col("vec_id")), F.lit(size)).cast("int").alias(name)


def nearest(
    table: DataFrame, every: int = 20, neighbours: int = NEIGHBOURS, share: float = LEAF_SHARE,
    rows_per_shard: int = ROWS_PER_SHARD, queries_per_block: int = QUERIES_PER_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each query, by inner product in double precision.

    `table` has vec_id and embedding.  Queries are the rows whose vec_id is
    divisible by `every`, candidates all other rows.  Vectors that are null,
    zero or hold null or non-finite components take no part, nor do rows
    without vec_id; shorter vectors count as filled up with zeros.  Rows that
    repeat a vec_id are one vector, that with the smallest hash.  Ties go to the
    smaller vec_id.  With fewer candidates than `neighbours` all come; without
    any, or on an empty table, no rows do.  Other columns are not read.
    """
    vectors = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    first = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.xxhash64("vector")))
    rows = vectors.where(F.col("vec_id").isNotNull() & usable("vector")).withColumn("copy", first).where("copy = 1").drop("copy")
    forest = fit(rows)
    if forest is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets = np.cumsum([0, *(t.leaves for t in forest.trees)])[:-1]
        for batch in batches:
            points = forest.indexed(stacked(batch.column("vector"), forest.width))
            leaves = np.column_stack([t.leaf_of(points) + o for t, o in zip(forest.trees, offsets, strict=True)])
            yield _listed(batch, list(leaves.astype(np.int32)))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = forest.asked(stacked(batch.column("vector"), forest.width))
            yield _listed(batch, [forest.reached(p, share, ENOUGH * neighbours + 1) for p in points])

    schema = "vec_id bigint, vector array<double>, leaves array<int>"
    index = keep(rows.mapInArrow(placed, schema), "forest")
    count = index.count()
    asking = index.where(F.col("vec_id") % every == 0).select("vec_id", "vector")
    shards, blocks = ceil(count / rows_per_shard) or 1, ceil(count / every / queries_per_block) or 1
    queries = asking.repartition(ceil(count / every / 256) or 1).mapInArrow(searched, schema)
    left = index.withColumn("shard", _block("shard", shards, 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", _block("block", blocks, 2)).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    width = forest.width
    leaf_count = sum(t.leaves for t in forest.trees)

    def ranked(held: pa.Table, asked: pa.Table) -> pa.Table:
        return _ranked(held, asked, width, leaf_count, neighbours)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        ranked, "query_id bigint, vec_id bigint, score double"
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= neighbours)
    return best.select("query_id", "rank", "vec_id", "score")


def _listed(batch: pa.RecordBatch, leaves: list[np.ndarray]) -> pa.RecordBatch:
    edges = np.concatenate(([0], np.cumsum([len(x) for x in leaves]))).astype(np.int32)
    flat = np.concatenate(leaves) if leaves else np.zeros(0, np.int32)
    lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(flat, pa.int32()))
    return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), lists], ["vec_id", "vector", "leaves"])


def _ranked(held: pa.Table, asked: pa.Table, width: int, leaf_count: int, neighbours: int) -> pa.Table:
    """The best candidates of one block of rows for one block of queries."""
    ids = held.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(ids) and asked.num_rows:
        vectors = stacked(held.column("vector"), width)[order]
        leaves = stacked(held.column("leaves"), len(held.column("leaves")[0])).astype(np.int64)[order]
        wanted = asked.column("vec_id").to_numpy()
        points = stacked(asked.column("vector"), width)
        reached = asked.column("leaves").to_pylist()
        # the product of matrices may round otherwise than the measure does; it
        # only finds what could be among the best
        doubt = 1e-9 * (1 + np.linalg.norm(vectors, axis=1).max() * np.linalg.norm(points, axis=1))
        for first in range(0, len(wanted), _QUERIES_AT_ONCE):
            near = points[first : first + _QUERIES_AT_ONCE] @ vectors.T
            for n, about in enumerate(near, start=first):
                open_leaf = np.zeros(leaf_count, bool)
                open_leaf[reached[n]] = True
                rows = np.flatnonzero(open_leaf[leaves].any(axis=1) & (ids != wanted[n]))
                about = about[rows]
                if len(rows) > neighbours:
                    least = np.partition(about, len(rows) - neighbours)[len(rows) - neighbours]
                    rows = rows[about >= least - doubt[n]]
                # row by row, so that equal vectors get equal scores to the last bit
                scores = np.einsum("ij,j->i", vectors[rows], points[n])
                # rows rise by id, so a stable sort breaks ties by the smaller one
                top = np.argsort(-scores, kind="stable")[:neighbours]
                out.append((np.full(len(top), wanted[n]), ids[rows[top]], scores[top]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
    return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})
