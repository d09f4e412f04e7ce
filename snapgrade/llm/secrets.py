"""Secrets in texts: base patterns, and spans of high entropy found by sliding windows.

All of it is column expressions. Positions come from one pattern that eats the gap before each match
(`\\G(.*?)(match)`), so the lengths of gaps and matches add up to code point positions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("assign", "access", "hex", "entropy")
# The base patterns. The group of the length bound is the last number but one.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6

WINDOW = 24
_UNIT = 1 << 20  # entropies are summed as whole numbers of this part of a bit
_BLOCK = 256


class EntropyClass(NamedTuple):
    """A class of characters: strings of it are candidates, a window at ``bits`` per character or more is hot."""

    alphabet: str
    bits: float


DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    EntropyClass(DIGITS + "abcdefABCDEF", 3.0),
    EntropyClass(DIGITS + LOWER + LOWER.upper() + "+/_=-", 4.0),
)
# Candidates that are no secrets: no digit or no letter, identifiers with dashes.
ALLOWED = (
    r"(?i)[^0-9]*",
    r"(?i)[^a-z]*",
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
)
# A segment between separators that has one of these words is a placeholder; what stands beside it is none.
SEPARATORS = "/_="  # and the dash
PLACEHOLDERS = ("example", "placeholder", "dummy", "redacted")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda total, x: total + x)


def running_sums(values: Column) -> Column:
    """The sums up to each element of an int array, block by block: long arrays cost little more than their length."""

    def ends(values: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(values) - 1) / F.lit(_BLOCK)).cast("int")),
            lambda i: F.slice(values, i * _BLOCK + 1, F.lit(_BLOCK)),
        )

        def of_blocks(blocks: Column) -> Column:
            def of_sums(sums: Column) -> Column:
                def one(block: Column, i: Column) -> Column:
                    return let(
                        _sum(F.slice(sums, F.lit(1), i)),
                        lambda base: F.transform(
                            F.sequence(F.lit(1), F.size(block)), lambda k: base + _sum(F.slice(block, F.lit(1), k))
                        ),
                    )

                return F.flatten(F.transform(blocks, one))

            return let(F.transform(blocks, _sum), of_sums)

        return let(blocks, of_blocks)

    return F.when(F.size(values) > 0, let(values, ends)).otherwise(F.array().cast("array<int>"))


def _none() -> Column:
    return F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")


def matches(text: Column, pattern: str, rank: int, value_group: int = 0) -> Column:
    """All leftmost matches that do not overlap: structs (start, rank, end, value).

    ``value_group`` counts groups inside the pattern; 0 is the whole match.
    """
    anchored = F.lit(rf"\G(?s:(.*?))({pattern})")
    parts = lambda group: F.regexp_extract_all(text, anchored, F.lit(group))

    def spans(gaps: Column, values: Column, ends: Column) -> Column:
        def one(end: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
            start = before + F.length(F.get(gaps, i))
            return F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.get(values, i).alias("value"))

        return F.transform(ends, one)

    found = let(
        F.struct(
            parts(1).alias("gaps"),
            parts(2 + value_group).alias("values"),
            running_sums(F.transform(parts(0), F.length)).alias("ends"),
        ),
        lambda m: spans(m["gaps"], m["values"], m["ends"]),
    )
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(_none())


def base_spans(text: Column) -> Column:
    """Spans of the base patterns by start, then kind."""
    assign = F.filter(matches(text, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= ASSIGN_LEAST)
    return F.array_sort(F.concat(assign, matches(text, ACCESS, 1), matches(text, HEX, 2)))


def hot_range(string: Column, kind: EntropyClass, window: int = WINDOW) -> Column:
    """Struct (first, last): the ends, from 1, of the first and last hot window of the string, or 0 and 0.

    One pass over the characters keeps the counts of the window's characters and the sum of
    count * log2(count): each step adds the entering and takes out the leaving character's change.
    """
    parts = F.array(*(F.lit(round(n * math.log2(n) * _UNIT) if n else 0).cast("long") for n in range(window + 2)))
    # entropy >= bits is a sum of at most window * (log2(window) - bits)
    most = math.floor(window * (math.log2(window) - kind.bits) * _UNIT)

    def scan(places: Column, parts: Column) -> Column:
        start = F.struct(
            F.array_repeat(F.lit(0), len(kind.alphabet)).alias("counts"),
            F.lit(0).cast("long").alias("sum"),
            F.lit(0).alias("first"),
            F.lit(0).alias("last"),
        )

        def step(state: Column, i: Column) -> Column:
            enter = F.get(places, i - 1)
            leave = F.when(i > window, F.get(places, i - 1 - window)).otherwise(-1)

            def after_leaving(counts: Column, total: Column) -> Column:
                more = F.get(counts, enter)
                now = total + F.get(parts, more + 1) - F.get(parts, more)
                return let(
                    now,
                    lambda now: F.struct(
                        F.transform(counts, lambda c, p: F.when(p == enter, c + 1).otherwise(c)).alias("counts"),
                        now.alias("sum"),
                        F.when((state["first"] == 0) & (i >= window) & (now <= most), i).otherwise(state["first"]).alias("first"),
                        F.when((i >= window) & (now <= most), i).otherwise(state["last"]).alias("last"),
                    ),
                )

            less = F.get(state["counts"], leave)
            left = F.struct(
                F.transform(state["counts"], lambda c, p: F.when(p == leave, c - 1).otherwise(c)).alias("counts"),
                F.when(leave >= 0, state["sum"] + F.get(parts, less - 1) - F.get(parts, less)).otherwise(state["sum"]).alias("sum"),
            )
            return let(left, lambda s: after_leaving(s["counts"], s["sum"]))

        folded = F.aggregate(F.sequence(F.lit(1), F.size(places)), start, step)
        return let(folded, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))

    places = F.transform(F.split(string, ""), lambda c: F.instr(F.lit(kind.alphabet), c) - 1)
    return let(
        F.struct(F.filter(places, lambda p: p >= 0).alias("places"), parts.alias("parts")),
        lambda s: scan(s["places"], s["parts"]),
    )


def pieces(run: Column, words: tuple = PLACEHOLDERS) -> Column:
    """What a run (start, rank, end, value) is without the segments that have one of the words, in the same form."""
    letter = rf"[^{SEPARATORS}\-]"
    # looked for at the starts of segments only, so that a long run takes one pass
    segment = rf"(?i)(?<!{letter}){letter}*?(?:{'|'.join(words)}){letter}*"

    def between(cuts: Column) -> Column:
        def one(i: Column) -> Column:
            first = F.when(i > 0, F.get(cuts, i - 1)["end"]).otherwise(0)
            last = F.when(i < F.size(cuts), F.get(cuts, i)["start"]).otherwise(F.length(run["value"]))
            return F.struct(
                (run["start"] + first).alias("start"),
                run["rank"].alias("rank"),
                (run["start"] + last).alias("end"),
                F.substring(run["value"], first + 1, last - first).alias("value"),
            )

        return F.transform(F.sequence(F.lit(0), F.size(cuts)), one)

    return let(matches(run["value"], segment, 0), between)


def entropy_spans(
    text: Column,
    base: Column,
    classes: tuple = CLASSES,
    allowed: tuple = ALLOWED,
    window: int = WINDOW,
    words: tuple = PLACEHOLDERS,
) -> Column:
    """Hot parts of candidate strings that no base span holds and no allowed pattern covers.

    A candidate is a run of at least ``window`` characters of a class, or what is left of one beside
    segments with a placeholder word, if that is long enough; what is reported goes from the
    start of its first hot window to the end of its last. An allowed pattern has to cover the whole candidate. A span
    that a base span holds is not reported; one that it only overlaps is.
    """
    def hot_part(kind: EntropyClass) -> Callable[[Column], Column]:
        return lambda s: let(
            hot_range(s["value"], kind, window),
            lambda h: F.when(
                h["first"] > 0,
                F.struct(
                    (s["start"] + h["first"] - window).alias("start"),
                    F.lit(3).alias("rank"),
                    (s["start"] + h["last"]).alias("end"),
                    F.substring(s["value"], h["first"] - window + 1, h["last"] - h["first"] + window).alias("value"),
                ),
            ),
        )

    def suspect(s: Column) -> Column:
        return ~F.coalesce(*(F.when(F.rlike(s["value"], F.lit(f"^(?:{p})$")), True) for p in allowed), F.lit(False))

    found = []
    for kind in classes:
        letters = "".join("\\-" if c == "-" else c for c in kind.alphabet)
        runs = matches(text, f"[{letters}]{{{window},}}", 3)
        strings = runs
        if words:
            strings = F.filter(F.flatten(F.transform(runs, lambda s: pieces(s, words))), lambda s: F.length(s["value"]) >= window)
        found.append(F.filter(F.transform(F.filter(strings, suspect), hot_part(kind)), lambda s: s.isNotNull()))
    inside = lambda s: F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    return F.array_sort(F.array_distinct(F.filter(F.concat(*found), lambda s: ~inside(s))))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def scan_secrets(docs: DataFrame, *, text: str = "text", output: str = "secrets") -> DataFrame:
    """The documents' columns plus ``secrets`` (in place of one of that name): struct(base, spans), arrays of (start, rank, end, value).

    ``rank`` is the kind's place in KINDS; positions are code points from 0, the end exclusive. ``base``
    holds the matches of the base patterns, ``spans`` these and the entropy spans, by start and kind.
    Null and empty texts have none; all rows are kept, repeated ones too.
    """
    # the whole row in one column, so that no name of the table meets one of the operator's
    packed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    based = packed.withColumn("base", base_spans(F.col("text")))
    both = F.struct(
        F.col("base"), F.array_sort(F.concat("base", entropy_spans(F.col("text"), F.col("base")))).alias("spans")
    )
    found = based.select("row", both.alias("found"))
    return found.select(*(F.col(f"row.`{c}`") for c in docs.columns if c != output), F.col("found").alias(output))


def without_secrets(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents in which nothing is found, with the same columns."""
    packed = docs.select(F.struct("*").alias("document"), F.col(f"`{text}`").alias("text"))
    return scan_secrets(packed).where(F.size("secrets.spans") == 0).select("document.*")
