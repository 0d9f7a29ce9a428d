"""Connected components of links between long ids, by alternating stars.

Each round hangs every node's larger neighbours on its smallest neighbour and
then joins the smaller ones, so that components become stars around their
smallest id after about log(n) rounds.  Links are written to the shared folder
after every round: nothing is collected, no group is gathered in one task (the
only aggregate is a minimum, merged before the shuffle), and a lost executor
costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.session import keep

MAX_ROUNDS = 100


def _smallest(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _smallest(both).select("a", F.least("a", "least").alias("least"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = _smallest(down)
    others = down.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return others.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b); component is the smallest id reachable.

    Self-links and repeated links change nothing; a node with self-links only
    may be left out, as its component is itself.  Links with a null end are
    ignored.  An empty input gives no rows.
    """
    links = links.select("a", "b").where("a is not null and b is not null and a <> b")
    links = keep(links.distinct(), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        links = keep(_small_star(_large_star(links)), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if state == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
