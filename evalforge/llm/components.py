"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregates (``min`` with map-side combine) and two joins on
the edge list; edges shrink to stars, in O(log^2 n) rounds at most.  A hub's
neighbours are never gathered: its minimum is a partial aggregate, and the
join that hands it out is one AQE can split.  Each round is written to the
shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, label) for every node of the edge list (a, b); label: the smallest node reachable.
    Self-loops and nulls are ignored; an empty list gives an empty result."""
    cur = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        now = tuple(cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if not now[0] or now == seen:
            break
        seen = now
        cur = written(_small_star(_large_star(cur)), "stars")
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("label"))
    return cur.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots).distinct()
