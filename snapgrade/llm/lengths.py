"""Exact histogram of encoded lengths, and what suffix sums over it answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from snapgrade.llm.tokens import token_counts
from snapgrade.llm.totals import running_totals
from snapgrade.session import materialise


def length_histogram(docs: DataFrame, *, text: str = "text", path: str | None = None) -> DataFrame:
    """One row per encoded length that occurs: length, n_docs. A null or empty text has length 0."""
    lengths = docs.select(token_counts(F.col(f"`{text}`"), path).alias("length"))
    return lengths.groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_table(histogram: DataFrame) -> DataFrame:
    """For each length L: documents and tokens at L or above, totals, and what a limit of L keeps.

    docs_from, tokens_from: of documents with at least L tokens. docs_to: with at most L; share_to is
    their part of all documents (the quantile of L). truncated_tokens: the total if every document is
    cut at L tokens. Between two lengths of the table all of these but truncated_tokens stay the same
    as at the next higher length; truncated_tokens grows by docs_from of that length per token.
    The table has one row per distinct length and is summed in range partitions.
    """
    histogram = histogram.withColumn("_tokens", F.col("length") * F.col("n_docs"))
    summed = running_totals(histogram, ["length"], {"_docs_below": "n_docs", "_tokens_below": "_tokens"})
    summed = materialise(summed, "lengths")
    all_of = summed.agg(F.sum("n_docs").alias("docs"), F.sum("_tokens").alias("tokens")).first()
    docs, tokens = F.lit(all_of.docs or 0).cast("long"), F.lit(all_of.tokens or 0).cast("long")
    docs_from = docs - F.col("_docs_below")
    docs_to = F.col("_docs_below") + F.col("n_docs")
    return summed.select(
        "length",
        "n_docs",
        docs_from.alias("docs_from"),
        (tokens - F.col("_tokens_below")).alias("tokens_from"),
        docs_to.alias("docs_to"),
        (docs_to / docs).alias("share_to"),
        (F.col("_tokens_below") + F.col("length") * docs_from).alias("truncated_tokens"),
        tokens.alias("total_tokens"),
    )


def quantiles(suffixes: DataFrame, shares: Sequence[float]) -> DataFrame:
    """The smallest length that at least a share of all documents does not exceed, one row per share."""
    found = [F.min(F.when(F.col("share_to") >= s, F.col("length"))).alias(f"q{i}") for i, s in enumerate(shares)]
    pairs = [F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("length")) for i, s in enumerate(shares)]
    return suffixes.agg(*found).select(F.inline(F.array(*pairs)))


def truncated_totals(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """Tokens kept and documents cut under each context limit, one row per limit."""
    length, n = F.col("length"), F.col("n_docs")
    sums = [
        c
        for i, limit in enumerate(limits)
        for c in (
            F.coalesce(F.sum(F.least(length, F.lit(limit)) * n), F.lit(0)).alias(f"k{i}"),
            F.coalesce(F.sum(F.when(length > limit, n)), F.lit(0)).alias(f"c{i}"),
        )
    ]
    rows = [
        F.struct(F.lit(int(limit)).cast("long").alias("limit"), F.col(f"k{i}").alias("tokens"), F.col(f"c{i}").alias("cut_docs"))
        for i, limit in enumerate(limits)
    ]
    return histogram.agg(*sums).select(F.inline(F.array(*rows)))
