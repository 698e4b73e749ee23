"""Dense ranks and running sums inside groups of any size.

A window over a whole group puts the group in one task. Here each row's 64-bit order key picks
one of many cells; cell totals (a small table) give each cell's offset, and windows run inside
cells only. There are as many cells as the rows need, so a group that holds a third of all rows is
spread over a third of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a cell may hold if one group has them all.
CELL_ROWS = 1 << 16
LEAST_CELLS = 64


def cells_for(rows: int) -> int:
    """A power of two: cells for so many rows."""
    return 1 << max(LEAST_CELLS.bit_length() - 1, (rows // CELL_ROWS).bit_length())


def cell_of(order: Column, cells: int) -> Column:
    """The cell of a 64-bit signed order key: ``cells`` (a power of two) equal key ranges."""
    shift = 64 - (cells.bit_length() - 1)
    return (F.shiftright(order, shift) + F.lit(cells // 2)).cast("int") if cells > 1 else F.lit(0)


def ranked(df: DataFrame, group: str, order: str, tie: str, weight: str | None = None, rows: int = 0) -> DataFrame:
    """Add ``rank`` (dense, from 0) and ``before`` (weight of the earlier rows) within ``group``.

    ``order`` must be a LONG spread evenly over 64 bits; ``tie`` breaks equal keys; ``rows`` is
    how many there are. A null group is a group.
    """
    df = df.withColumn("_cell", cell_of(F.col(order), cells_for(rows)))
    mass = F.col(weight) if weight else F.lit(0).cast("long")
    totals = df.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_n"), F.sum(mass).alias("_w"))
    earlier = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col(group).alias("_g"),
        F.col("_cell").alias("_c"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_w0"),
    )
    inside = Window.partitionBy(group, "_cell").orderBy(order, tie)
    df = df.withColumn("_r", F.row_number().over(inside) - 1).withColumn(
        "_b", F.coalesce(F.sum(mass).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    joined = df.join(totals, df[group].eqNullSafe(totals["_g"]) & (df["_cell"] == totals["_c"]), "left")
    return joined.withColumns({"rank": F.col("_n0") + F.col("_r"), "before": F.col("_w0") + F.col("_b")}).drop(
        "_cell", "_g", "_c", "_n0", "_w0", "_r", "_b"
    )
