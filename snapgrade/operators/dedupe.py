"""Key cleaning, first row per key, and joins that keep only what is new."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from snapgrade.functions.text import is_blank, trim_all

SEPARATOR = "|"


def clean_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop rows with a null or blank key part and trim the rest."""
    kept = df
    for key in keys:
        kept = kept.filter(~is_blank(F.col(key)))
    return kept.withColumns({key: trim_all(F.col(key)) for key in keys})


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of every key in the given order.

    The plan holds a window group limit on both sides of the exchange: each task passes on at
    most one row per key, so a key with very many copies does not load one task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= 1).drop("_rank")


def composite_key(*parts: Column, separator: str = SEPARATOR) -> Column:
    return F.concat_ws(separator, *[trim_all(part) for part in parts])


def anti_existing(
    candidates: DataFrame, stored: DataFrame, keys: Sequence[str], order: Sequence[Column | str] | None = None
) -> DataFrame:
    """Rows whose key is neither stored nor seen earlier among the candidates.

    Copies are dropped first, so the join sees one row per key on the left side, and the
    distinct keys on the right.
    """
    first = candidates if order is None else first_per_key(candidates, keys, order)
    return first.join(stored.select(*keys).distinct(), list(keys), "left_anti")


@dataclass(frozen=True)
class GroupedPairs:
    """Stored pairs that are not listed: every key of ``left(key, group)`` with every key of ``right(key, group)`` in its group.

    Listed, the pairs of a group grow with the product of its sides. A null group pairs nothing.
    """

    left: DataFrame
    right: DataFrame
    group: str

    def among(self, asked: DataFrame) -> DataFrame:
        """The asked pairs that are stored, in work that grows with the asked pairs and the two sides.

        Both sides have a row per key in small files, so they are not left to a broadcast.
        """
        first, second = (next(c for c in side.columns if c != self.group) for side in (self.left, self.right))
        left = self.left.select(first, self.group).distinct().hint("merge")
        right = self.right.select(second, self.group).distinct().hint("merge")
        return asked.select(first, second).join(left, first).join(right, [second, self.group], "left_semi").select(first, second)


def key_set(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).distinct()


def key_difference(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are stored but not incoming."""
    return stored.select(*keys).join(incoming.select(*keys), list(keys), "left_anti")
