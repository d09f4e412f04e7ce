"""Quality rules on documents, judged by host.

Rule failures are added up by host; a host's rate of each rule is shrunk with a beta prior that the
hosts themselves give; hosts whose rate passes a limit fail, and their verdict is joined back.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from snapgrade.session import materialise

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
REPEAT_WINDOW = 5

STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
_STRUCT = pa.struct([(f.split()[0], pa.int64()) for f in STATS.split(", ")])


@dataclass(frozen=True)
class Limits:
    """What a document may have, and what rate of failures a host may have."""

    least_words: int = 10  # fixed value
    repeat_percent: int = 20  # fixed value
    symbols_per_word: float = 1.0
    dup_line_share: float = 0.5
    word_length: tuple[float, float] = (2.0, 15.0)
    host_rate: float = 0.5


def repeated_words(words: list[str], window: int = REPEAT_WINDOW) -> int:
    """Words that stand in a window of words which the list has twice or more."""
    if len(words) <= window:
        return 0
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    # the number of each run, longer by one word at a time: equal runs have equal numbers
    runs = ids
    for more in range(1, window):
        _, runs = np.unique(runs[: len(ids) - more] * len(numbers) + ids[more:], return_inverse=True)
    again = np.bincount(runs)[runs] > 1
    inside = np.zeros(len(ids), bool)
    for k in range(window):
        inside[k : len(ids) - window + 1 + k] |= again
    return int(inside.sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return (0,) * 6
    words = text.translate(_TO_BLANK).split(" ")
    words = [w for w in words if w]
    lines, dups, seen = 0, 0, set()
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            dups += line in seen
        seen.add(line)
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), sum(map(len, words)), symbols, lines, dups, repeated_words(words)


_TO_BLANK = str.maketrans(dict.fromkeys(BLANKS, " "))


def stats(text: Column | str) -> Column:
    """Struct of counts of each whole text; null has none."""

    @F.arrow_udf(STATS)
    def count(texts: pa.Array) -> pa.Array:
        columns = zip(*map(text_stats, texts.to_pylist())) if len(texts) else [[]] * 6
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(_STRUCT))

    return count(text)


def rule_failures(stats: Column, limits: Limits = Limits()) -> dict[str, Column]:
    """The rules by name, each true for a failure; the first two are the base."""
    words = stats["n_words"]
    length = stats["word_chars"] / F.greatest(words, F.lit(1))
    low, high = limits.word_length
    return {
        "few_words": words < limits.least_words,
        "repeats": stats["n_repeat_words"] * 100 > words * limits.repeat_percent,
        "symbols": stats["n_symbols"] > words * limits.symbols_per_word,
        "dup_lines": stats["n_dup_lines"] > stats["n_lines"] * limits.dup_line_share,
        "word_length": (words > 0) & ((length < low) | (length > high)),
    }


def shrunk_rates(hosts: DataFrame, rules: list[str]) -> DataFrame:
    """Add ``rate_<rule>`` to rows (host, n, <rule> ...): (failures + a) / (n + a + b).

    a and b fit the hosts' rates by their mean and variance, weighted by documents; a + b is kept
    between 1 and 10000, so that equal rates (or a single host) pull to the mean but never divide by
    zero.
    """
    weight = F.col("n")
    sums = [F.sum(weight).alias("n")]
    for rule in rules:
        rate = F.col(rule) / F.col("n")
        sums += [F.sum(F.col(rule)).alias(f"f_{rule}"), F.sum(weight * rate * rate).alias(f"s_{rule}")]
    row = hosts.agg(*sums).first()
    added = {}
    for rule in rules:
        n = row["n"] or 1
        mean = (row[f"f_{rule}"] or 0) / n
        variance = max((row[f"s_{rule}"] or 0.0) / n - mean * mean, 0.0)
        strength = mean * (1 - mean) / variance - 1 if variance > 0 else 10000.0
        strength = min(max(strength, 1.0), 10000.0)
        added[f"rate_{rule}"] = (F.col(rule) + mean * strength) / (F.col("n") + strength)
    return hosts.withColumns(added)


def judge_documents(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", limits: Limits = Limits()
) -> DataFrame:
    """One row per document: doc_id, host, the counts, base_failed, rules_failed, host_failed, kept.

    A document is kept if it fails neither the base nor another rule itself and its host passes: no
    rule's shrunk rate there is above ``host_rate``. A null host is a host; a null or empty text has
    no words and fails; rows that repeat are judged and counted each; an empty table gives no rows.
    Failures are added up within tasks before the shuffle, so a host with very many documents is one
    row per task.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{host}`").alias("host"), stats(F.col(f"`{text}`")).alias("_stats")
    )
    rules = rule_failures(F.col("_stats"), limits)
    rows = rows.select("doc_id", "host", "_stats.*", *(c.alias(r) for r, c in rules.items()))
    rows = materialise(rows, "rules")
    counted = rows.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.col(r).cast("long")).alias(r) for r in rules))
    rates = shrunk_rates(materialise(counted, "hosts"), list(rules))
    failed = F.greatest(*(F.col(f"rate_{r}") for r in rules)) > limits.host_rate
    verdicts = materialise(rates.select(F.col("host").alias("_host"), failed.alias("host_failed")), "verdicts")
    base = F.col("few_words") | F.col("repeats")
    own = F.filter(
        F.array(*(F.when(F.col(r), F.lit(r)) for r in rules)), lambda r: r.isNotNull()
    )
    return rows.join(verdicts, F.col("host").eqNullSafe(F.col("_host"))).select(
        "doc_id", "host", *(f.name for f in _STRUCT), base.alias("base_failed"), own.alias("rules_failed"), "host_failed",
        ((F.size(own) == 0) & ~F.col("host_failed")).alias("kept"),
    )
