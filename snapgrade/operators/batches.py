"""Fixed-size batches of a globally ordered frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from snapgrade.session import materialise

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def with_position(df: DataFrame, order: Sequence[Column | str], output: str = "position") -> DataFrame:
    """Zero-based position in the order, without a one-task window.

    Rows are range-partitioned and sorted; their number inside the partition is known without
    a shuffle, and one small aggregate gives the rows before each partition. The range bounds
    come from a sample, so the sorted rows are materialised once: both readers must see the
    same partitions. ``order`` should end in a unique column, else a value with very many
    copies lands in one partition. Pass only the columns needed further on.
    """
    marked = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mark", F.monotonically_increasing_id())
    )
    fixed = (
        materialise(marked, "positions")
        .withColumn("_part", F.shiftright("_mark", _ROW_BITS))
        .withColumn("_row", F.col("_mark").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    )
    sizes = fixed.groupBy("_part").agg((F.max("_row") + 1).alias("_size"))
    # This window and the broadcast hold one row per range partition, never data rows.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        fixed.join(F.broadcast(offsets), "_part")
        .withColumn(output, F.col("_offset") + F.col("_row"))
        .drop("_mark", "_part", "_row", "_offset")
    )


def assign_batches(
    df: DataFrame, order: Sequence[Column | str], size: int, *, batch: str = "batch", position: str = "position"
) -> DataFrame:
    """Batch number by position; all batches but the last hold exactly ``size`` rows."""
    return with_position(df, order, position).withColumn(batch, F.floor(F.col(position) / F.lit(size)).cast("long"))
