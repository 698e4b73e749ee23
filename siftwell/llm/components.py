"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import hot_limit, materialize

MOST_ROUNDS = 60
#: So many edges are small for one task, whatever their nodes.
PLAIN_EDGES = 100_000


def _met(edges: DataFrame, low: DataFrame, limit: int | None) -> DataFrame:
    """``edges`` with ``m`` of their node ``a``; nodes of more than ``limit`` edges are broadcast."""
    if limit is None:
        return edges.join(low.select("a", "m"), "a")
    hubs = low.where(F.col("n") > limit).select("a", "m")
    met = edges.join(F.broadcast(hubs), "a", "left")
    dealt = met.where("m is null").drop("m").join(low.where(F.col("n") <= limit).select("a", "m"), "a")
    return met.where("m is not null").unionByName(dealt)


def _large_star(edges: DataFrame, limit: int | None) -> DataFrame:
    """Link each node's larger neighbours to its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _met(both.where("b > a"), low, limit).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, limit: int | None) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _met(down, low, limit).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, plain: int = PLAIN_EDGES) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node with an edge.

    Rounds end when a step changes nothing; each is cut by a checkpoint. A step shuffles each edge
    once by its node; the edges of a node that has very many stay where they are.
    """
    edges = materialize(edges.select("a", "b").where("a <> b").distinct())
    seen = F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))
    mark = None
    for _ in range(MOST_ROUNDS):
        now = tuple(edges.agg(*seen).first())
        if now == mark:
            break
        mark = now
        limit = hot_limit(2 * now[0]) if now[0] > plain else None
        edges = materialize(_small_star(_large_star(edges, limit), limit))
    else:
        raise RuntimeError("components did not converge")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return materialize(stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct()))
