"""Connected components by alternating large-star and small-star.

(Kiveris et al. 2014.)  Edges stay distributed; every round is written to the
shared folder, so lineage stays short and survives lost executors.  A hub's
neighbours are never gathered: its smallest neighbour is an aggregate, and the
join that brings it back is one that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release

ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (a, b): each node's neighbours are linked to its smallest."""
    if large:  # every neighbour larger than the node goes to the smallest of all, the node included
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:  # only from the larger end
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")) if large else both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select("b", "m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component is its smallest node.

    Loops and repeated edges do no harm; without edges the result is empty.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(ROUNDS):
        edges = cut(_star(_star(edges, True), False), "stars", edges)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        release(edges.sparkSession)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
