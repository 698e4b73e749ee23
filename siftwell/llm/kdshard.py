"""Sharding by k-d tree partitioning with distributed weighted medians.

Points are groups of equal texts (pre-aggregated, weighted by bytes) placed by metadata: log
size, language, source and first id, all scaled to one unit. The tree splits each node along its
widest dimension at the weighted quantile that fits the leaves on either side, until each leaf
holds its share of the target bytes. A weighted quantile is found by narrowing histograms: each
pass sums bytes in at most ``BINS`` bins per node, so the driver sees bins, never points.

A group heavier than ``1 / PIECES`` of a leaf is dealt into pieces by its ids, so a text that a
third of all rows share neither bends the sizes nor lands in one task; at most
``PIECES * shards`` such groups can exist, which bounds the broadcast that marks them. Smaller
groups stay whole.

Defined cases: a null text has no bytes (size 16) and no checksum, and groups with other nulls;
null language, source or id is a value of its own; repeated rows are rows, and points that tie in
every dimension are ordered by the group's hash; a text longer than a shard is a shard's share by
itself, and its bytes are counted, never held; an empty table has no shards. Only the columns named
here are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.ranks import ranked
from siftwell.llm.shared import materialize

BINS = 1024
PIECES = 4
OVERHEAD = 16
#: Log size, language, source, first id.
DIMENSIONS = 4
KEY = ("h", "size", "piece")


@dataclass
class Node:
    """Leaves ``first .. first + leaves - 1``, with its weight and range along ``dim``."""

    first: int
    leaves: int
    dim: int = 0
    mass: int = 0
    low: int = 0
    high: int = 0
    cut: int = 0


def _unit(value: Column, low, high) -> Column:
    """``value`` scaled to 30 bits, with the group's hash below it as a tie-break."""
    span = float(high - low) or 1.0
    scaled = ((value - F.lit(low)) / F.lit(span) * F.lit(float((1 << 30) - 1))).cast("long")
    return F.shiftleft(scaled, 32).bitwiseOR(F.col("hp").bitwiseAND(F.lit(0xFFFFFFFF)))


def _points(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their piece, and one weighted point per group piece."""
    low, high, small, large, total = rows.agg(F.min("doc_id"), F.max("doc_id"), F.min("size"), F.max("size"), F.sum("size")).first()
    if total is None:
        return rows.withColumn("piece", F.lit(0)), rows.sparkSession.createDataFrame([], "h long")
    most = max(1, total // (shards * PIECES))
    heavy = rows.groupBy("h", "size").agg(F.sum("size").alias("mass")).where(F.col("mass") > most)
    heavy = heavy.select(F.col("h").alias("_h"), F.col("size").alias("_s"), F.ceil(F.col("mass") / F.lit(most)).alias("_p"))
    marked = rows.join(F.broadcast(heavy), (rows["h"] == heavy["_h"]) & (rows["size"] == heavy["_s"]), "left")
    rows = marked.withColumn(
        "piece", F.coalesce(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.col("_p")), F.lit(0)).cast("int")
    ).drop("_h", "_s", "_p")
    groups = rows.groupBy(*KEY).agg(
        F.sum("size").alias("mass"), F.min("lang").alias("lang"), F.min("source").alias("source"), F.min("doc_id").alias("first_id")
    )

    def hashed(c: str) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(5), c), 34).cast("double")

    points = groups.withColumn("hp", F.xxhash64("h", "piece")).select(
        *KEY,
        "mass",
        F.lit(0).alias("node"),
        F.array(
            _unit(F.log2(F.col("size")), math.log2(small), math.log2(large)),
            _unit(hashed("lang"), 0.0, float(1 << 30)),
            _unit(hashed("source"), 0.0, float(1 << 30)),
            _unit(F.coalesce(F.col("first_id"), F.lit(low or 0)).cast("double"), float(low or 0), float(high or 0)),
        ).alias("x"),
    )
    return rows, materialize(points)


def _measure(points: DataFrame, todo: dict[int, Node]) -> dict[int, Node]:
    """Weight, widest dimension and range of each open node that has points."""
    aggs = [F.sum("mass").alias("mass")]
    for d in range(DIMENSIONS):
        aggs += [F.min(F.col("x")[d]).alias(f"lo{d}"), F.max(F.col("x")[d]).alias(f"hi{d}")]
    for r in points.groupBy("node").agg(*aggs).collect():
        if node := todo.get(r["node"]):
            node.dim = max(range(DIMENSIONS), key=lambda d: (r[f"hi{d}"] >> 32) - (r[f"lo{d}"] >> 32))
            node.mass, node.low, node.high = r["mass"], r[f"lo{node.dim}"], r[f"hi{node.dim}"]
    return {k: n for k, n in todo.items() if n.mass}


def _by_node(points: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """Join a parameter row to each point of its node; there are at most as many as shards."""
    return points.join(F.broadcast(points.sparkSession.createDataFrame(rows, schema)), "node")


def _cut(points: DataFrame, todo: dict[int, Node], slack: float) -> None:
    """Find each open node's cut by narrowing histograms."""
    # node -> (bytes wanted left of the cut, bytes known to be left, low, high)
    search = {k: (n.mass * (n.leaves // 2) / n.leaves, 0, n.low, n.high) for k, n in todo.items()}
    while search:
        rows = [(k, todo[k].dim, lo, hi, (hi - lo) // BINS + 1) for k, (_, _, lo, hi) in search.items()]
        boxed = _by_node(points, rows, "node int, dim int, lo long, hi long, step long").select(
            "node", "mass", F.expr("x[dim]").alias("x"), "lo", "hi", "step"
        )
        bins = (
            boxed.where("x between lo and hi")
            .groupBy("node", F.expr("(x - lo) div step").alias("bin"))
            .agg(F.sum("mass").alias("mass"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        )
        found: dict[int, list] = {}
        for r in bins.collect():
            found.setdefault(r["node"], []).append((r["bin"], r["mass"], r["lo"], r["hi"]))
        following = {}
        for k, parts in found.items():
            want, left, _, _ = search[k]
            for _, mass, lo, hi in sorted(parts):
                if left + mass >= want:
                    break
                left += mass
            if lo < hi and mass > slack:
                following[k] = (want, left, lo, hi)
            else:
                todo[k].cut = lo if want - left < left + mass - want else hi + 1
        search = following


def split(points: DataFrame, shards: int, total: int) -> DataFrame:
    """Points with ``node`` as their shard: each level is one pass of measuring, cutting, moving."""
    todo = {0: Node(0, shards)} if shards > 1 else {}
    while todo := _measure(points, todo) if todo else {}:
        _cut(points, todo, total / shards / 500)
        rows = [(k, n.dim, n.cut, k + n.leaves // 2) for k, n in todo.items()]
        params = F.broadcast(points.sparkSession.createDataFrame(rows, "node int, dim int, cut long, upper int"))
        moved = F.when(F.expr("x[dim] >= cut"), F.col("upper")).otherwise(F.col("node"))
        points = materialize(points.join(params, "node", "left").select(*KEY, "mass", moved.alias("node"), "x"))
        halves = [h for k, n in todo.items() for h in (Node(k, n.leaves // 2), Node(k + n.leaves // 2, n.leaves - n.leaves // 2))]
        todo = {h.first: h for h in halves if h.leaves > 1}
    return points


def kd_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row; law ``bytes``."""
    rows = materialize(
        docs.select(
            "doc_id",
            "lang",
            "source",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
            F.crc32("text").alias("text_crc32"),
            F.xxhash64(F.lit(1), F.col("text").isNull(), "text").alias("h"),
        )
    )
    pieced, points = _points(rows, shards)
    if "mass" in points.columns:
        total = points.agg(F.sum("mass")).first()[0]
        leaves = split(points, shards, total).select("h", "size", "piece", F.col("node").alias("shard"))
        placed = pieced.join(leaves, ["h", "size", "piece"])
    else:
        placed = pieced.withColumn("shard", F.lit(0))
    placed = placed.select("doc_id", "size", "text_crc32", "shard", F.xxhash64(F.lit(9), "doc_id", "h").alias("order"))
    return ranked(placed, "shard", "order", "doc_id", rows=rows.count()).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("rank").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
