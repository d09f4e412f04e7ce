"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from snapgrade.session import materialise


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Point every larger neighbour (large star), or every smaller one and the node (small star), to the least."""
    if large:
        near = _both_ways(links)
    else:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).withColumn("low", F.least("low", "node"))
    joined = near.join(least, F.col("a") == F.col("node"))
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(
            least.select(F.col("node").alias("a"), F.col("low").alias("b"))
        )
    return moved.where("a <> b").distinct()


def _sign(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return row.n, row.x


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): the least node that can be reached, itself left out.

    Each round points the neighbours of a node at its least neighbour, first the larger, then the
    smaller ones; links shrink to one star per component in a number of rounds that grows with the
    logarithm of its size. A node with very many links is pre-aggregated, and the join back is one
    that Spark splits when it is skewed. Every round is a table in the shared folder.
    """
    links = materialise(links.where("a <> b").distinct(), "links")
    sign = _sign(links)
    while sign[0]:
        links = materialise(_star(materialise(_star(links, True), "star"), False), "star")
        before, sign = sign, _sign(links)
        if sign == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
