"""Size-aware heavy-light n-gram Jaccard join, and the components of its links.

A document's set is its distinct five-word shingles. Sets up to a boundary are *light*: they
enumerate their subsets of the fixed sizes that a linked pair must share. Larger sets are
*heavy*: they enter inverted lists by the rarest shingles of their prefix, so that two linked
sets meet in at least one list. The boundary minimises the counted cost of both.

Lists are rare-first. Every task packs its distinct shingles by bucket; a bucket's reducer keeps
the shingles that occur in two sets or more, as sorted arrays in the shared folder. Buckets grow
with the input, rows in proportion to it (see ``shared.deal``). A second pass
maps them: a set in which fewer than its needed share occur elsewhere can have no link and goes
no further, and the rest order their shingles by frequency. Order and filter only steer cost;
the test of a pair compares whole sets, mapped from the shared folder. Texts are cut into shingles
twice: to count, and to find each row's set.

Links are found in rounds, because a list of near copies would give all its pairs. First each list
links its members to a few heads, then in ``BRIDGES`` turns to more heads, all at a cost
linear in the lists (``HEADS`` entries at most), and the components of those links are found. At last all pairs of members
that are still in different components are compared, with size and position bounds. No link
between components is lost, and none inside one is needed.

Defined cases: texts without words and null texts have the empty set, no links, and are their
own component; texts under five words are one shingle; equal sets are one node; rows with equal
ids share the id's component; a null id is kept with a null component unless linked to a smaller
id; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read.

Limit: a set is named by 64 bits of its shingles' hashes, so two sets of one name count as one: of
ten billion distinct sets about 2.7 pairs. Rows are told apart by 128 bits.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.components import components
from siftwell.llm.shared import BLOB, blob_batch, carried, deal, input_bytes, lookup, map_array, materialize, put_array, row_key, runs, shared_folder, small_batches, without
from siftwell.llm.tokens import STEP, hash_words, mix, slices, text_bytes, windows

WIDTH = 5
#: The threshold as a ratio of whole numbers.
TOP, BOTTOM = 75, 100
BUCKET_BYTES = 8 << 20
#: Text bytes that a worker cuts into sets at once.
SETS_BYTES = 3 << 20
#: Bits of a bucket number that one shuffle deals by.
FAN = 11
#: Most partitions that write sets.
WRITERS = 1 << 14
#: Largest light set that the cost may choose; larger ones have too many subsets.
MOST_LIGHT = 12
#: Turns of linear linking before the exact comparison, and entries of a list that each turn tries.
BRIDGES, HEADS = 1, 32


def needed(n):
    """Fewest shingles that a set of ``n`` shares with a linked set at least as large as the union's share."""
    return -(-TOP * n // BOTTOM)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted; row bounds; a hash of each set (0 for the empty)."""
    data, offsets = text_bytes(column)
    words = hash_words(data, offsets)
    h, at = windows(words, WIDTH)
    row = words.rows[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < WIDTH))
    if len(short):
        whole = []
        for i in short:
            x = np.uint64(0)
            for w in words.hashes[words.bounds[i] : words.bounds[i + 1]]:
                x = np.uint64((int(x) * int(STEP) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            whole.append(x)
        h = np.concatenate((h, mix(np.array(whole, np.uint64) + words.counts[short].astype(np.uint64))))
        row = np.concatenate((row, short))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        first = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))
        h, row = h[first], row[first]
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ STEP), dtype=np.uint64)))
    ids = mix(np.diff(sums[bounds]) + np.diff(bounds).astype(np.uint64))
    ids[np.diff(bounds) == 0] = 0
    return h, bounds, ids


@dataclass
class Layout:
    """The shared folder and its buckets, by the top bits of a hash."""

    folder: str
    bits: int
    fan: int = FAN

    @property
    def first(self) -> int:
        """Bits of the first deal."""
        return min(self.fan, self.bits)

    def bucket(self, h: np.ndarray, bits: int | None = None) -> np.ndarray:
        return (h >> np.uint64(64 - (bits or self.bits))).astype(np.int64)

    def short(self, h: np.ndarray) -> np.ndarray:
        """The 32 bits below the bucket's."""
        return ((h << np.uint64(self.bits)) >> np.uint64(32)).astype(np.uint32)

    def blobs(self, h: np.ndarray, counts: np.ndarray, bits: int) -> list[tuple[int, int, bytes]]:
        """One row per bucket of sorted hashes: whole hashes on the way, short ones in their own bucket."""
        key, counts = self.short(h) if bits == self.bits else h, np.minimum(counts, 255).astype(np.uint8)
        return [(b, s.stop - s.start, key[s].tobytes() + counts[s].tobytes()) for b, s in runs(self.bucket(h, bits))]


def _summed(ns, raws, kind) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of some rows, sorted, and their counts."""
    size = np.dtype(kind).itemsize
    keys = np.concatenate([np.frombuffer(raw, kind, n) for n, raw in zip(ns, raws, strict=True)])
    counts = np.concatenate([np.frombuffer(raw, np.uint8, n, size * n) for n, raw in zip(ns, raws, strict=True)]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[order], first)


def _frequencies(docs: DataFrame, layout: Layout) -> None:
    """Write, per bucket, the shingles of two sets or more and their frequency class."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                h, bounds, ids = shingle_sets(part.column(0))
                # Equal sets of one slice count once; those of other slices only cost a second look.
                _, one = np.unique(ids, return_index=True)
                keep = np.zeros(len(ids), bool)
                keep[one] = True
                yield blob_batch(layout.blobs(*np.unique(h[np.repeat(keep, np.diff(bounds))], return_counts=True), layout.first))

    def reduce(key, table):
        keys, counts = _summed(table["n"].to_pylist(), table["data"].to_pylist(), np.uint32)
        often = counts > 1
        b = key[0].as_py()
        put_array(f"{layout.folder}/df-{b}", keys[often])
        put_array(f"{layout.folder}/class-{b}", np.minimum(np.log2(counts[often]), 63).astype(np.uint8))
        return pa.table({"shingles": [int(often.sum())]})

    found = docs.select("text").mapInArrow(run, BLOB)
    found = deal(found, layout.first, layout.bits, layout.fan, lambda ns, raws, bits: layout.blobs(*_summed(ns, raws, np.uint64), bits))
    found.groupBy("bucket").applyInArrow(reduce, "shingles long").agg(F.sum("shingles")).collect()


class _Classes:
    """A worker's view of the frequency arrays: class of each hash, 0 if in one set only."""

    def __init__(self, layout: Layout) -> None:
        self.layout, self.maps = layout, {}

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """``h`` sorted and distinct."""
        out = np.zeros(len(h), np.uint8)
        key = self.layout.short(h)
        for b, s in runs(self.layout.bucket(h)):
            if b not in self.maps:
                self.maps[b] = (map_array(f"{self.layout.folder}/df-{b}", np.uint32), map_array(f"{self.layout.folder}/class-{b}", np.uint8))
            held, cls = self.maps[b]
            if len(held):
                at = np.minimum(np.searchsorted(held, key[s]), len(held) - 1)
                out[s] = np.where(held[at] == key[s], cls[at], 0)
        return out


def light_subsets(shingles: np.ndarray, n: int) -> list[int]:
    """Keys of the subsets that a light set enumerates.

    For each size ``b`` that a linked set at least as large can have, linked sets of sizes up to
    ``b`` share ``needed(b)`` shingles: both enumerate all subsets of that fixed size, tagged ``b``.
    """
    out = []
    b = n
    while needed(b) <= n:
        for subset in combinations(shingles.tolist(), needed(b)):
            x = np.array(subset, np.uint64)
            out.append(int(mix(mix(x + np.uint64(b)).sum(keepdims=True, dtype=np.uint64))[0]))
        b += 1
    return out


def light_cost(n: int) -> int:
    """How many subsets a set of ``n`` enumerates."""
    total, b = 0, n
    while needed(b) <= n:
        total += comb(n, needed(b))
        b += 1
    return total


def prefix_length(n: int) -> int:
    """Linked sets share a shingle among so many of their first in a common order."""
    return n - needed(n) + 1


def choose_boundary(sizes: dict[int, int], mean_list: float) -> int:
    """The largest size up to which subsets cost no more than scanning prefix lists."""
    best, boundary, light, heavy = 0.0, 0, 0.0, 0.0
    for n in range(1, MOST_LIGHT + 1):
        light += sizes.get(n, 0) * light_cost(n)
        heavy += sizes.get(n, 0) * prefix_length(n) * max(1.0, mean_list)
        if light - heavy <= best:
            best, boundary = light - heavy, n
    return boundary


def _with_sets(docs: DataFrame, carry: list[str], layout: Layout) -> DataFrame:
    """The ``carry`` columns of every row with ``n_shingles, node``; and for sets that may have a link, once
    for each slice, ``alone, shingles`` (rarest first).
    """
    inputs, schema = carried(docs, carry, F.col("text").alias("text"))
    schema += "n_shingles long, node long, alone int, shingles binary"
    width = len(carry)

    def run(batches):
        classes = _Classes(layout)
        for batch in batches:
            for part in slices(batch, "text", SETS_BYTES):
                h, bounds, ids = shingle_sets(part.column(width))
                distinct, inverse = np.unique(h, return_inverse=True)
                cls = classes(distinct)[inverse]
                n = np.diff(bounds)
                shared = np.diff(np.concatenate((np.zeros(1, np.int64), np.cumsum(cls > 0)))[bounds])
                # A set of n shares needed(n) shingles with each linked set.
                stay = np.flatnonzero((n > 0) & (shared >= needed(n)))
                _, one = np.unique(ids[stay], return_index=True)
                sets: list[bytes | None] = [None] * len(n)
                for i in stay[one]:
                    s = slice(bounds[i], bounds[i + 1])
                    sets[i] = h[s][np.lexsort((h[s], cls[s]))].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(i) for i in range(width)),
                        pa.array(n),
                        pa.array(ids.view(np.int64)),
                        pa.array((n - shared).astype(np.int32)),
                        pa.array(sets, pa.binary()),
                    ],
                    [*part.schema.names[:width], "n_shingles", "node", "alone", "shingles"],
                )

    return inputs.mapInArrow(run, schema).toDF(*carry, "n_shingles", "node", "alone", "shingles")


def _store(sets: DataFrame, layout: Layout) -> DataFrame:
    """Write distinct sets by bucket of their node; return ``node, n, alone, head`` of each.

    A task's sets come sorted by bucket and node, so it holds one bucket at a time; ``head`` is
    the part of the prefix that lists need: after the shingles that no other set has.
    """

    def write(bucket, nodes, sizes, values):
        put_array(f"{layout.folder}/node-{bucket}", np.array(nodes, np.int64))
        put_array(f"{layout.folder}/start-{bucket}", np.concatenate(([0], np.cumsum(sizes))).astype(np.int64))
        put_array(f"{layout.folder}/set-{bucket}", np.concatenate(values))

    def run(batches):
        own, nodes, sizes, values = None, [], [], []
        for batch in batches:
            heads = []
            for bucket, node, n, alone, raw in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if nodes and node == nodes[-1]:
                    continue
                if bucket != own:
                    if nodes:
                        write(own, nodes, sizes, values)
                    own, nodes, sizes, values = bucket, [], [], []
                h = np.frombuffer(raw, np.uint64)
                nodes.append(node)
                sizes.append(n)
                values.append(np.sort(h))
                keep = h if n <= MOST_LIGHT else h[alone : prefix_length(n)]
                heads.append((node, n, alone, keep.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in heads], pa.int64()),
                    pa.array([r[1] for r in heads], pa.int32()),
                    pa.array([r[2] for r in heads], pa.int32()),
                    pa.array([r[3] for r in heads], pa.binary()),
                ],
                ["node", "n", "alone", "head"],
            )
        if nodes:
            write(own, nodes, sizes, values)

    dealt = sets.withColumn("bucket", F.shiftrightunsigned("node", 64 - layout.bits).cast("int"))
    dealt = dealt.select("bucket", "node", F.col("n_shingles").cast("int").alias("n"), "alone", "shingles")
    ordered = dealt.repartition(min(1 << layout.bits, WRITERS), "bucket").sortWithinPartitions("bucket", "node")
    return ordered.mapInArrow(run, "node long, n int, alone int, head binary")


class _Sets:
    """A worker's view of the stored sets."""

    def __init__(self, layout: Layout) -> None:
        self.layout, self.maps = layout, {}

    def __call__(self, node: int) -> np.ndarray:
        b = (node & 0xFFFFFFFFFFFFFFFF) >> (64 - self.layout.bits)
        if b not in self.maps:
            f = self.layout.folder
            self.maps[b] = (map_array(f"{f}/node-{b}", np.int64), map_array(f"{f}/start-{b}", np.int64), map_array(f"{f}/set-{b}", np.uint64))
        nodes, starts, values = self.maps[b]
        i = int(np.searchsorted(nodes, node))
        return values[starts[i] : starts[i + 1]]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if BOTTOM * len(small) < TOP * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return BOTTOM * both >= TOP * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, layout: Layout) -> DataFrame:
    """The pairs ``a, b`` whose whole sets are linked."""

    def run(batches):
        sets = _Sets(layout)
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            good = np.zeros(len(a), bool)
            last, own = None, None
            for i in range(len(a)):
                if a[i] != last:
                    last, own = a[i], sets(int(a[i]))
                good[i] = linked(own, sets(int(b[i])))
            yield batch.filter(pa.array(good))

    return pairs.select("a", "b").mapInArrow(run, "a long, b long")


def _postings(nodes: DataFrame, boundary: int) -> DataFrame:
    """List entries ``key, node, n, left``: ``left`` bounds what may be shared from the entry on."""
    # A heavy set's lists also hold the light sets that its links may reach.
    listed = needed(boundary + 1)

    def run(batches):
        for batch in batches:
            keys, rows, left = [], [], []
            n = batch.column(1).to_pylist()
            alone = batch.column(2).to_pylist()
            for i, raw in enumerate(batch.column(3).to_pylist()):
                h = np.frombuffer(raw, np.uint64)
                if n[i] <= boundary:
                    subsets = light_subsets(np.sort(h), n[i])
                    keys.append(np.array(subsets, np.uint64))
                    rows.append(np.full(len(subsets), i))
                    left.append(np.full(len(subsets), n[i]))
                if n[i] > boundary or n[i] >= listed:
                    stop = prefix_length(n[i])
                    own = h[alone[i] : stop] if n[i] <= MOST_LIGHT else h
                    keys.append(own ^ np.uint64(1))
                    rows.append(np.full(len(own), i))
                    left.append(n[i] - alone[i] - np.arange(len(own)))
            if not keys:
                continue
            at = pa.array(np.concatenate(rows).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(keys).astype(np.uint64).view(np.int64)),
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    pa.array(np.concatenate(left).astype(np.int32)),
                ],
                ["key", "node", "n", "left"],
            )

    return nodes.mapInArrow(run, "key long, node long, n int, left int")


def _star_pairs(lists: DataFrame) -> DataFrame:
    """Each member of a list with the list's heads: its smallest set, its largest, one by hash."""
    order = F.xxhash64(F.lit(31), "node")
    heads = lists.groupBy("key").agg(
        F.min_by("node", F.struct("n", "node")).alias("h0"), F.max_by("node", F.struct("n", "node")).alias("h1"), F.min_by("node", order).alias("h2"), F.count(F.lit(1)).alias("size")
    )
    heads = heads.where("size > 1").select("key", F.explode(F.array_distinct(F.array("h0", "h1", "h2"))).alias("head"))
    pairs = lists.join(heads, "key").where("node <> head")
    return pairs.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()


def _mixed(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries, with their component ``c``, of the lists that hold more than one component."""
    named = lists.join(labels, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    mixed = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    return materialize(named.join(mixed, "key"))


def _allowed() -> Column:
    """What size and position leave possible for entries ``_a`` and ``_b`` of one list."""
    large, small = F.greatest("n_a", "n_b"), F.least("n_a", "n_b")
    shared = F.least("left_a", "left_b")
    return (
        (F.col("c_a") != F.col("c_b"))
        & (BOTTOM * small >= TOP * large)
        & ((BOTTOM + TOP) * shared >= TOP * (F.col("n_a") + F.col("n_b")))
    )


def _side(entries: DataFrame, suffix: str) -> DataFrame:
    return entries.select("key", *(F.col(c).alias(c + suffix) for c in ("node", "n", "left", "c")))


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _bridge_pairs(mixed: DataFrame, turn: int) -> DataFrame:
    """Each entry with at most ``HEADS`` entries of its list, others in each turn, in other components."""
    order = F.xxhash64(F.lit(1000 + turn), "node", "key")
    head = mixed.groupBy("key", F.pmod(order, F.lit(HEADS)).alias("place")).agg(F.min_by(F.struct("node", "n", "left", "c"), order).alias("h"))
    pairs = _side(mixed, "_a").join(head.select("key", *(F.col(f"h.{c}").alias(f"{c}_b") for c in ("node", "n", "left", "c"))), "key")
    return _distinct_pairs(pairs.where(_allowed()))


def _open_pairs(mixed: DataFrame) -> DataFrame:
    """All pairs of entries of one list that are in different components and may be linked."""
    pairs = _side(mixed, "_a").join(_side(mixed, "_b"), "key").where(_allowed() & (F.col("c_a") < F.col("c_b")))
    return _distinct_pairs(pairs)


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after more links: components of components."""
    lifted = links
    for side in ("a", "b"):
        found = lookup(lifted, side, labels.withColumnRenamed("node", side))
        lifted = found.withColumn(side, F.coalesce("component", side)).select("a", "b")
    upper = components(lifted).select(F.col("node").alias("component"), F.col("component").alias("_top"))
    fresh = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
    known = materialize(labels.unionByName(fresh.withColumn("component", F.col("node"))))
    return materialize(lookup(known, "component", upper).select("node", F.coalesce("_top", "component").alias("component")))


def node_components(docs: DataFrame, carry: list[str], fan: int = FAN, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame, int]:
    """Every row's ``carry`` columns, ``n_shingles, node``; ``node, component`` of all nodes with a link; the light boundary."""
    small_batches(docs.sparkSession)
    bits = max(5, (max(1, input_bytes(docs)) // bucket_bytes).bit_length())
    layout = Layout(shared_folder(docs.sparkSession, "jaccard"), bits, fan)
    _frequencies(docs, layout)
    rows = materialize(_with_sets(docs, carry, layout))
    nodes = materialize(_store(rows.where("shingles is not null").select("node", "n_shingles", "alone", "shingles"), layout))
    sizes = {r["n"]: r["count"] for r in nodes.where(F.col("n") <= MOST_LIGHT).groupBy("n").count().collect()}
    heavy = _postings(nodes, 0)
    m = heavy.groupBy("key").count().agg(F.sum(F.col("count") * F.col("count")).alias("sq"), F.sum("count").alias("n")).first()
    boundary = choose_boundary(sizes, float(m["sq"] or 0) / max(1, m["n"] or 0))
    lists = _postings(nodes, boundary)
    often = lists.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key")
    lists = materialize(lists.join(often, "key"))
    labels = components(materialize(_verified(_star_pairs(lists), layout)))
    # A few turns with other heads absorb what the first heads missed, at a cost linear in the lists.
    for turn in range(BRIDGES):
        links = materialize(_verified(_bridge_pairs(_mixed(lists, labels), turn), layout))
        if links.isEmpty():
            break
        labels = _relabelled(labels, links)
    # What is left decides exactly.
    links = materialize(_verified(_open_pairs(_mixed(lists, labels)), layout))
    return rows.drop("alone", "shingles"), _relabelled(labels, links), boundary


def jaccard_components(docs: DataFrame, carry: tuple[str, ...] = (), **dealing: int) -> DataFrame:
    """``doc_id``, the ``carry`` columns, ``n_shingles, component_id, node, component`` for every row."""
    rows, names, _ = node_components(docs, ["doc_id", *carry], **dealing)
    # The smallest id of each set, then of each component; both are partial aggregates.
    filled = rows.where("n_shingles > 0")
    per_node = filled.groupBy("node").agg(F.min("doc_id").alias("low"))
    linked = names.join(per_node, "node")
    lows = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    placed = lookup(names, "component", materialize(lows)).select(F.col("node").alias("_n"), "component", "component_id")
    every = per_node.join(placed, F.col("node") == F.col("_n"), "left")
    own = F.when(F.col("_n").isNull(), F.col("low")).otherwise(F.col("component_id"))
    known = materialize(every.select("node", F.coalesce("component", "node").alias("component"), own.alias("component_id")))
    found = ["doc_id", *carry, "n_shingles", "component_id", "node", "component"]
    empty = rows.where("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "component": F.lit(None).cast("long")})
    return lookup(filled, "node", known).select(*found).unionByName(empty.select(*found))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each component, that of the smallest id; documents without words all stay.

    Of rows with equal id and text one stays.
    """
    key = row_key("doc_id", "text").alias("key")
    found = materialize(jaccard_components(docs.select(key, "doc_id", "text"), ("key",)))
    # Two components may have one smallest id, where ids repeat: group by the component itself.
    group = F.when(F.col("n_shingles") > 0, F.col("component"))
    winners = found.groupBy(group.alias("g"), F.when(group.isNull(), F.col("key")).alias("own")).agg(F.min(F.struct("doc_id", "key")).alias("w"))
    losers = found.join(winners.select("w.key"), "key", "left_anti")
    # Whole rows travel as one struct, so no column of theirs can clash.
    kept = without(docs.select(key, F.struct("*").alias("row")), losers, "key")
    repeated = found.groupBy("key").count().where("count > 1").limit(1).count()
    return (kept.dropDuplicates(["key"]) if repeated else kept).select("row.*")
