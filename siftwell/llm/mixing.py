"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source's words lie in blocks of at most ``block_words`` words of one document, in a fixed
permuted order. A source's quota is a number of passes over that order, the last one cut where
the target is met, so quotas are exact. The tree splits the vector of block quotas over ranges
of output shards: each node draws its left part from a multivariate hypergeometric
distribution, down to one shard. Prefix sums give each shard disjoint ranges of each source's
permuted blocks; a shard's own order is a hash.

``mixed_documents`` draws whole documents: then a block is a document. Where each shard's range of
a source begins is a place in the permutation, so a few keys for each source and shard tell every
row by itself how often it is drawn and into which shards; rows are dealt once, by shard, and
shuffled there.

The driver holds one row per source and shard (a mix names its sources), never blocks or documents.
Running sums come from cells (see ``ranks``), so a source with a third of all rows has no task of
its own.

Defined cases: a null text has size 0; a null source is a source, ordered last; documents
without words are never drawn; texts of any length are counted in whole; an empty table gives an
empty mix; rows with equal ids are rows, and rows that are equal in id, text and source are drawn
alike. Only ``doc_id``, ``text`` and ``source`` are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.ranks import cell_of, ranked
from siftwell.llm.shared import input_bytes, materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
# Beyond this many balls the sampler's own limit is near; a normal draw replaces it.
EXACT_DRAWS = 5 * 10**8
PART_BYTES = 128 << 20


def targets(sizes: dict[str | None, int], weights=WEIGHTS, most: int = MOST_REPEATS) -> dict[str | None, float]:
    """Words per source: shares of all words by weight, held at ``most`` times the source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    free, rest = list(order), float(sum(sizes.values()))
    while free:
        share = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / share > most * sizes[s]]
        if not over:
            out |= {s: rest * weight[s] / share for s in free}
            break
        for s in over:
            out[s] = float(most * sizes[s])
        rest -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def _drawn(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good."""
    if n == 0 or good == 0:
        return 0
    if max(good, bad) < EXACT_DRAWS:
        return int(rng.hypergeometric(good, bad, n))
    whole = good + bad
    mean = n * good / whole
    deviation = (mean * (bad / whole) * ((whole - n) / max(1, whole - 1))) ** 0.5
    return int(min(max(round(rng.normal(mean, deviation)), max(0, n - bad)), min(good, n)))


def splitting_tree(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """Per shard, the blocks of each source: recursive hypergeometric halving of the quotas."""
    out: list[list[int]] = [[] for _ in range(shards)]

    def divide(vector: list[int], first: int, count: int) -> None:
        if count == 1:
            out[first] = vector
            return
        half = count // 2
        left, want, rest = [], sum(vector) * half // count, sum(vector)
        rng = np.random.default_rng([seed, first, count])
        for q in vector:
            rest -= q
            k = _drawn(rng, q, rest, want)
            left.append(k)
            want -= k
        divide(left, first, half)
        divide([q - k for q, k in zip(vector, left, strict=True)], first + half, count - half)

    divide(list(quotas), 0, shards)
    return out


def size_column() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """Rows with a row id, word count and permutation hash, computed once."""
    row = F.monotonically_increasing_id().alias("rid")
    return materialize(docs.select(row, "doc_id", "source", size_column().alias("size"), F.xxhash64("doc_id", "text").alias("h")))


def source_table(rows: DataFrame) -> dict[str | None, int]:
    return {r["source"]: r["size"] for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}


def _plan(spark, rows: DataFrame) -> tuple[DataFrame, dict]:
    """Sources with ``source_size, target, passes, rest``, as a table and by name."""
    sizes = source_table(rows)
    goal = targets(sizes)
    plan = {}
    for s, size in sizes.items():
        passes, rest = divmod(round(goal[s]), size) if size else (0, 0)
        plan[s] = (size, goal[s], *((MOST_REPEATS, 0) if passes >= MOST_REPEATS else (passes, rest)))
    table = spark.createDataFrame([(s, *p) for s, p in plan.items()], "source string, source_size long, target double, passes int, rest long")
    return table, plan


def _permuted(rows: DataFrame, sources: DataFrame, block_words: int | None, seed: int) -> DataFrame:
    """Blocks with ``rank`` in their source's permutation and ``last``, the words that the last pass takes."""
    length = F.lit(block_words) if block_words else F.greatest("size", F.lit(1))
    blocks = (
        rows.where("size > 0")
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / length).cast("long"))))
        .withColumn("words", F.least(length.cast("long"), F.col("size") - F.col("block") * length).cast("long"))
        .withColumn("key", F.xxhash64(F.lit(seed), "h", "block"))
        .select("rid", "source", "block", "words", "key")
    )
    n, words = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    count = n + ((words or 0) // block_words if block_words else 0)
    placed = ranked(blocks, "source", "key", "rid", weight="words", rows=count).alias("b")
    p = sources.select(F.col("source").alias("p_source"), "passes", "rest").alias("p")
    placed = placed.join(p, F.col("b.source").eqNullSafe(F.col("p_source")))
    last = (
        F.least(F.greatest(F.col("rest") - F.col("before"), F.lit(0)), F.col("words"))
        if block_words
        else F.when(F.col("before") + F.col("words") / 2 <= F.col("rest"), F.col("words")).otherwise(0)
    )
    return materialize(placed.select("rid", "source", "block", "words", "key", "rank", "passes", last.cast("long").alias("last")))


def _shares(placed: DataFrame, plan: dict, shards: int, seed: int) -> list[tuple]:
    """(source, blocks, blocks of its last pass, where each shard's blocks end in its passes)."""
    counts = placed.groupBy("source").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.when(F.col("last") > 0, 1).otherwise(0)).alias("partial"))
    found = {r["source"]: (r["blocks"], r["partial"]) for r in counts.collect()}
    order = sorted(found, key=lambda s: (s is None, s or ""))
    shares = splitting_tree([plan[s][2] * found[s][0] + found[s][1] for s in order], shards, seed)
    return [(s, *found[s], [int(x) for x in np.cumsum([v[i] for v in shares])]) for i, s in enumerate(order)]


def draw(rows: DataFrame, shards: int = 16, block_words: int = 256, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The mix and its sources.

    Returns draws ``rid, block, epoch, words, shard, order`` and sources ``source, source_size,
    target``.
    """
    spark = rows.sparkSession
    sources, plan = _plan(spark, rows)
    placed = _permuted(rows, sources, block_words, seed)
    edges = [(s, blocks, ends) for s, blocks, _, ends in _shares(placed, plan, shards, seed)]
    e = spark.createDataFrame(edges, "e_source string, blocks long, edges array<long>")
    drawn = (
        placed.withColumn("epoch", F.explode(F.expr("sequence(0, passes)")))
        .withColumn("words", F.when(F.col("epoch") < F.col("passes"), F.col("words")).otherwise(F.col("last")))
        .where("words > 0")
        .join(e, F.col("source").eqNullSafe(F.col("e_source")))
        .withColumn("at", F.col("epoch") * F.col("blocks") + F.col("rank"))
        .withColumn("shard", F.size(F.filter("edges", lambda x: x <= F.col("at"))))
        .select("rid", "block", F.col("epoch").cast("int").alias("epoch"), "words", "shard", F.xxhash64(F.lit(seed + 1), "key", "epoch", "shard").alias("order"))
    )
    return drawn, sources.select("source", "source_size", "target")


def mix(docs: DataFrame, shards: int = 16, block_words: int = 256, seed: int = 17) -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, taken, shards``."""
    rows = sized(docs)
    drawn, sources = draw(rows, shards, block_words, seed)
    taken = drawn.groupBy("rid").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_set("shard")).alias("shards"))
    s = sources.withColumnRenamed("source", "s_source")
    return (
        rows.join(taken, "rid", "left")
        .join(s, rows["source"].eqNullSafe(s["s_source"]), "left")
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
            F.coalesce("shards", F.array().cast("array<int>")).alias("shards"),
        )
    )


def _cuts(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    """For each source and pass, the shards that draw from it and the keys below which each one's documents lie."""
    spark = rows.sparkSession
    sources, plan = _plan(spark, rows)
    placed = _permuted(rows, sources, None, seed)
    wanted = []
    for s, blocks, partial, ends in _shares(placed, plan, shards, seed):
        for epoch in range(plan[s][2] + (partial > 0)):
            size, start = blocks if epoch < plan[s][2] else partial, 0
            for shard, end in enumerate(ends):
                stop = min(end - epoch * blocks, size)
                if stop > start:
                    wanted.append((s, epoch, shard, stop, stop == blocks))
                    start = stop
    ends = spark.createDataFrame(wanted, "w_source string, epoch int, shard int, stop long, open boolean")
    # The first document behind each end; behind the end of a whole pass there is none, so it has no key.
    same = F.col("source").eqNullSafe(F.col("w_source")) & (F.col("rank") == F.col("stop"))
    closed = placed.select("source", "rank", "key").join(F.broadcast(ends.where("not open")), same).select("w_source", "epoch", "shard", "stop", "key")
    found = closed.unionByName(ends.where("open").select("w_source", "epoch", "shard", "stop", F.lit(None).cast("long").alias("key")))
    passes = found.groupBy("w_source", "epoch").agg(F.array_sort(F.collect_list(F.struct("stop", "key", "shard"))).alias("cuts"))
    return passes.groupBy("w_source").agg(F.collect_list(F.struct("epoch", "cuts")).alias("passes"))


def drawn_documents(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """``row, shard, order``: each row as often as it is drawn whole."""
    h = F.xxhash64("doc_id", "text", F.col("source").isNull(), "source")
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), "source", size_column().alias("size"), h.alias("h")))
    # One row for each source: what the driver held before.
    cuts = materialize(_cuts(rows, shards, seed))
    key = F.xxhash64(F.lit(seed), h, F.lit(0).cast("long"))
    some = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    # Whole rows travel as one struct, so no column of theirs can clash.
    named = docs.where(some).select(F.col("source").alias("m_source"), key.alias("m_key"), F.struct("*").alias("row"))
    drawn = named.join(F.broadcast(cuts), F.col("m_source").eqNullSafe(F.col("w_source"))).select("m_key", "row", F.explode("passes").alias("p"))
    # The first shard whose end lies behind the row; rows behind all ends are not drawn in that pass.
    into = F.try_element_at(F.filter("p.cuts", lambda c: c["key"].isNull() | (F.col("m_key") < c["key"])), F.lit(1))
    order = F.xxhash64(F.lit(seed + 1), "m_key", "p.epoch").alias("order")
    return drawn.select("row", into["shard"].alias("shard"), order).where("shard is not null")


def mixed_documents(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """The mix as documents with their own columns.

    A partition holds a range of a shard's shuffled order, as long as ``PART_BYTES`` of input.
    """
    cells = 1 << (input_bytes(docs) // (shards * PART_BYTES)).bit_length()
    drawn = drawn_documents(docs, shards, seed).withColumn("cell", cell_of(F.col("order"), cells))
    return drawn.repartition(shards * cells, "shard", "cell").sortWithinPartitions("shard", "order").select("row.*")
