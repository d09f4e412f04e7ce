"""Declared constraints as data-quality jobs: every check returns rows, none raises by itself."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` itself, after a job has shown its keys to be unique."""
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"duplicate keys in {list(keys)}")
    return df


def _long_form(summary: DataFrame, check: str, columns: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("violations")) for c in columns])
    return summary.select(F.lit(check).alias("check"), F.explode(pairs).alias("p")).select("check", "p.*")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _long_form(df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]), "not_null", columns)


def too_long(df: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    counts = [F.count_if(F.length(c) > n).alias(c) for c, n in limits.items()]
    return _long_form(df.agg(*counts), "max_length", list(limits))


def orphans(child: DataFrame, foreign_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Foreign key values without a parent and their rows.

    Child rows are counted per value before the join, so a value with very many rows is one
    row in the shuffle.
    """
    values = child.filter(F.col(foreign_key).isNotNull()).groupBy(foreign_key).agg(F.count(F.lit(1)).alias("rows"))
    known = parent.select(F.col(parent_key).alias(foreign_key)).distinct()
    return values.join(known, foreign_key, "left_anti")


def vector_widths(df: DataFrame, vector: str) -> DataFrame:
    """One row: narrowest, widest, and whether the table has one width."""
    return df.agg(F.min(F.size(vector)).alias("narrowest"), F.max(F.size(vector)).alias("widest")).withColumn(
        "one_width", F.col("narrowest") == F.col("widest")
    )


# Accepted values of the enumerated columns.
ACCEPTED = {
    "change_type": ("INSERT", "UPDATE", "DELETE"),
    "status": ("RUNNING", "COMPLETED", "FAILED"),
    "log_level": ("INFO", "WARNING", "ERROR"),
    "pass_fail": ("PASS", "FAIL"),
    "eval_type": ("CLASSIFICATION", "PLAVALOVA", "LLM_JUDGE"),
    "dimension": ("accuracy", "completeness", "reasoning"),
}


def outside_domain(df: DataFrame, column: str, accepted: Sequence[str]) -> DataFrame:
    """Values that are not accepted, with their rows. Null is a matter of the null check."""
    return (
        df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*accepted))
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
