"""Session factory, table loading, and what plans need to be computed once and spread evenly."""

from __future__ import annotations

import os

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: Bytes that are worth a task of their own.
TASK_BYTES = 32 << 20
#: Bytes of an Arrow batch, so that a worker's memory does not depend on how long rows are.
BATCH_BYTES = 8 << 20


def session(name: str = "siftwell", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE, Arrow in bounded batches).

    Master, memory and shuffle partitions are local defaults; values given here win, and so do
    those of ``spark-submit``.
    """
    from pyspark import SparkConf

    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    given = dict(SparkConf().getAll())
    local = {
        "spark.master": f"local[{cpus}]",
        "spark.app.name": name,
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
    }
    needed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    spark = SparkSession.builder.config(map={**local, **given, **needed, **conf}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def once(df: DataFrame) -> DataFrame:
    """``df`` for several uses, computed once.

    Checkpointed where the session names a shared folder; else kept by the block manager, which
    computes a lost part again.
    """
    sc = df.sparkSession.sparkContext
    folder = sc.getCheckpointDir() or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def planned_bytes(df: DataFrame) -> int | None:
    """What the planner knows of the size of the tables that ``df`` reads; costs no job."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length()))
    return size if size < 1 << 60 else None


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small input over all cores, before work that costs more than its bytes.

    Large inputs have more partitions than cores as they are read, and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = planned_bytes(df)
    return df.repartition(cores) if size is not None and size <= cores * TASK_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
