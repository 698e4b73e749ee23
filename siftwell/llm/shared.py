"""Files that every executor can see, and helpers to cut lineage.

The shared folder is the one the session names in ``spark.checkpoint.dir``. Where none is named, a
local session (as in tests) gets a folder of its own, and any other session is an error: a folder
of one machine is no shared one. A ``file:`` folder is mounted everywhere, so workers map its files
directly. Any other scheme goes through ``pyarrow.fs``; a worker then copies a file to its own
temporary folder, maps the copy and unlinks it at once.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.session import planned_bytes

#: Rows of the largest table that is broadcast, two longs each.
SMALL_ROWS = 1_000_000


def _base(spark: SparkSession) -> str:
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='siftwell-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder URI below the session's shared folder."""
    base = _base(spark)
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    uri = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    make_folder(uri)
    return uri


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder and cut its lineage there."""
    _base(df.sparkSession)
    return df.checkpoint(eager=True)


def row_key(*columns: Column | str) -> Column:
    """128 bits of a row: equal for equal values, nulls told from empty ones."""
    parts = [x for c in columns for x in ((F.col(c) if isinstance(c, str) else c).isNull(), c)]
    return F.struct(F.xxhash64(F.lit(41), *parts).alias("a"), F.xxhash64(F.lit(43), *parts).alias("b"))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is not in ``gone``.

    A small ``gone``, counted first, is broadcast, so wide rows stay where they are; else both are
    dealt by the key, which no other row shares.
    """
    gone = materialize(gone.select(key).distinct())
    return rows.join(F.broadcast(gone) if gone.count() <= SMALL_ROWS else gone, key, "left_anti")


#: Keys that are broadcast: those of so many rows, and how many there can be.
LEAST_HOT, MOST_HOT = 1000, 10_000
#: Rows of a table that is broadcast as a whole for a lookup.
FEW_ROWS = 100_000


def hot_limit(rows: int) -> int:
    """Beyond so many rows a key is hot; at most ``MOST_HOT`` keys can be."""
    return max(LEAST_HOT, rows // MOST_HOT)


def lookup(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """``rows``, left-joined to ``table``, which has each ``key`` once and was computed before.

    A table of ``FEW_ROWS`` at most, counted first, is broadcast. Of a larger one the entries of hot
    keys are, so their rows stay where they are; others are dealt.
    """
    if table.count() <= FEW_ROWS:
        return rows.join(F.broadcast(table), key, "left")
    rows = materialize(rows)
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_limit(rows.count())).select(key)
    near = table.join(F.broadcast(hot), key, "left_semi").withColumn("_near", F.lit(True))
    met = rows.join(F.broadcast(near), key, "left")
    dealt = met.where("_near is null").select(*rows.columns).join(table, key, "left")
    return met.where("_near").drop("_near").unionByName(dealt)


#: Rows of ``deal``: a bucket, how many entries, and the entries.
BLOB = "bucket long, n int, data binary"


def blob_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["bucket", "n", "data"])


def deal(blobs: DataFrame, first: int, bits: int, fan: int, regroup, held: int = 1 << 20) -> DataFrame:
    """Rows by the first bits of their entries' buckets to rows by all bits, ``fan`` bits more at a time.

    ``regroup(ns, datas, bits)`` merges the entries of some rows into rows by ``bits``. A task calls
    it for rows of one bucket with fewer than ``held`` entries in all, so what it writes is in
    proportion to what it reads. It need not see all rows of a bucket, so large ones split.
    """
    at = first
    while at < bits:
        at = min(bits, at + fan)

        def run(batches, bits=at):
            own, rows, size = None, [], 0
            for batch in batches:
                for b, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if rows and (b != own or size + n > held):
                        yield blob_batch(regroup(*zip(*rows, strict=True), bits))
                        rows, size = [], 0
                    rows.append((n, raw))
                    own, size = b, size + n
            if rows:
                yield blob_batch(regroup(*zip(*rows, strict=True), bits))

        blobs = blobs.hint("rebalance", "bucket").sortWithinPartitions("bucket").mapInArrow(run, BLOB)
    return blobs


def runs(values: np.ndarray) -> list[tuple[int, slice]]:
    """(value, slice) of each run of a sorted array."""
    if not len(values):
        return []
    edges = np.flatnonzero(np.append(True, values[1:] != values[:-1])).tolist()
    return [(int(values[a]), slice(a, b)) for a, b in zip(edges, [*edges[1:], len(values)], strict=True)]


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Hold the session's Arrow batches to about ``size`` bytes, so workers' memory is bounded by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def carried(docs: DataFrame, columns: list[str], *more: Column) -> tuple[DataFrame, str]:
    """``docs`` as its columns under names that clash with nothing, then ``more``; and their schema."""
    named = docs.select(*(F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(columns)), *more)
    return named, "".join(f"{f.name} {f.dataType.simpleString()}, " for f in named.schema[: len(columns)])


def hash_sample(rows: DataFrame, order: str, size: int, *ties: str) -> DataFrame:
    """The ``size`` rows with the smallest hashes; ``order`` is a LONG spread over 64 bits.

    A bound from the row count lets few more than ``size`` rows through to the final top-n, so no
    task ships a full sample of its own.
    """
    total = rows.count()
    share = min(1.0, 1.1 * size / max(1, total) + 1000 / max(1, total))
    near = rows if share >= 1.0 else rows.where(F.col(order) <= F.lit(int((2 * share - 1) * (2**63 - 1))))
    return near.orderBy(order, *ties).limit(size)


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` URI, None for any other scheme."""
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    """Create the folder and its parents."""
    path = local_path(uri)
    if path is not None:
        os.makedirs(path, exist_ok=True)
    else:
        store, inner = _store(uri)
        store.create_dir(inner, recursive=True)


def put_bytes(uri: str, payload) -> None:
    """Write a file in one step: a retried or speculative task replaces it by equal bytes."""
    path = local_path(uri)
    if path is not None:
        partial = f"{path}.{uuid.uuid4().hex}.partial"
        with open(partial, "wb") as f:
            f.write(payload)
        os.replace(partial, path)
    else:
        store, inner = _store(uri)
        with store.open_output_stream(inner) as f:
            f.write(payload)


def put_array(uri: str, array: np.ndarray) -> None:
    """Write an array as raw little-endian items; ``map_array`` reads it back."""
    put_bytes(uri, np.ascontiguousarray(array).data.cast("B") if array.size else b"")


def map_array(uri: str, dtype) -> np.ndarray:
    """Memory-map a file that ``put_array`` wrote; a missing or empty file is an empty array."""
    path = local_path(uri)
    if path is not None:
        if not os.path.exists(path) or os.path.getsize(path) == 0:
            return np.empty(0, dtype)
        return np.memmap(path, dtype=dtype, mode="r")
    store, inner = _store(uri)
    with tempfile.NamedTemporaryFile() as copy:
        try:
            with store.open_input_stream(inner) as source:
                while block := source.read(1 << 22):
                    copy.write(block)
        except FileNotFoundError:
            return np.empty(0, dtype)
        copy.flush()
        if os.path.getsize(copy.name) == 0:
            return np.empty(0, dtype)
        return np.memmap(copy.name, dtype=dtype, mode="r")


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` reads, by the planner's statistics, which cost no job.

    Rows that come from no table (a checkpoint, local data) have no statistics: their texts are
    measured.
    """
    known = planned_bytes(df)
    return known if known is not None else int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
