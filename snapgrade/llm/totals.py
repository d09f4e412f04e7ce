"""Running totals over a global order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from snapgrade.session import materialise


def running_totals(
    df: DataFrame, order: Sequence[Column | str], totals: Mapping[str, str], by: str | None = None
) -> DataFrame:
    """Add, for each ``output: column`` of ``totals``, the column's sum over the rows before this one.

    The order runs within each value of ``by`` (null is a value too), else over all rows. Rows are
    range-partitioned by (``by``, order), so that a value of ``by`` with very many rows is spread
    over many tasks; each task sums its own part, and one row per part and value of ``by`` gives
    what stands before the part. Rows that tie in the order get their sums in some order among
    themselves. Null counts as 0. Range bounds come from a sample, so the parts are written once.
    Pass only the columns needed further on: the rows are shuffled twice.
    """
    own = [by] if by else []
    parted = materialise(
        df.repartitionByRange(*own, *order).withColumn("_part", F.spark_partition_id()), "totals"
    )
    inside = Window.partitionBy(*own, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # rows of this window: one per range partition (and value of by that the partition holds)
    ahead = Window.partitionBy(*own).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parted.groupBy(*own, "_part").agg(*(F.sum(c).alias(f"_sum_{o}") for o, c in totals.items()))
    before = sums.select(
        *(F.col(c).alias(f"_b_{c}") for c in [*own, "_part"]),
        *(F.coalesce(F.sum(f"_sum_{o}").over(ahead), F.lit(0)).alias(f"_before_{o}") for o in totals),
    )
    match = F.col("_part") == F.col("_b__part")
    if by:
        match = match & F.col(by).eqNullSafe(F.col(f"_b_{by}"))
    local = parted.withColumns(
        {f"_inside_{o}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for o, c in totals.items()}
    )
    return local.join(before, match).select(
        *df.columns, *((F.col(f"_before_{o}") + F.col(f"_inside_{o}")).alias(o) for o in totals)
    )
