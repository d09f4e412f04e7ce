"""Batch, judge and report texts. Header and footer wording is a parameter."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from snapgrade.functions import rules
from snapgrade.functions.text import fixed, fixed_or, labelled_line, text_or

# Label, column and decimals (None: as it is) of an entity line.
LINE_FIELDS = (
    ("name", "planet_name", None),
    ("disc_year", "discovery_year", None),
    ("method", "discovery_method", None),
    ("mass_earth", "planet_mass", 2),
    ("radius_earth", "planet_radius", 2),
    ("period_days", "orbital_period", 2),
    ("ecc", "eccentricity", 3),
    ("temp_k", "equilibrium_temp", 0),
    ("density", "planet_density", 2),
    ("insol", "insolation_flux", 2),
)
JUDGE_LINE_FIELDS = (
    ("mass_earth", "planet_mass", 2),
    ("radius_earth", "planet_radius", 2),
    ("period_days", "orbital_period", 2),
    ("ecc", "eccentricity", 3),
    ("temp_k", "equilibrium_temp", 0),
    ("density", "planet_density", 2),
    ("disc_year", "discovery_year", None),
)

# Formats of the context block and of the report.
CONTEXT_TITLE = "  RESEARCH CONTEXT:"
CONTEXT_START, CONTEXT_RELEVANCE = "  - ", " (relevance: "
REPORT_SAMPLE = 50
REPORT_SUMMARY = "Summary: %d inserts, %d updates, %d deletes.\n\n"
REPORT_START = "--- CHANGES (sample, max {sample}) ---\n"
REPORT_MORE = "\n... and %d more."
REPORT_END = "\n--- END CHANGES ---\n"

DEFAULT_CLASSIFY_HEADER = (
    "Give each entity a quality label and a four-letter code. Answer with a JSON array only.\n--- PLANETS ---"
)
DEFAULT_JUDGE_HEADER = "Score each label from 1 to 10. Answer with a JSON array only.\n--- PLANETS ---"
DEFAULT_FOOTER = "--- END PLANETS ---"
DEFAULT_REPORT_HEADER = "Summarise these changes in a few factual sentences.\n"


def entity_line(fields: Sequence[tuple[str, str, int | None]] = LINE_FIELDS) -> Column:
    return labelled_line(
        [(label, text_or(F.col(c)) if d is None else fixed_or(F.col(c), d)) for label, c, d in fields]
    )


def judge_line(name: str, label: str, fields: Sequence[tuple[str, str, int | None]] = JUDGE_LINE_FIELDS) -> Column:
    quality, code = rules.split_label(F.col(label))
    first = labelled_line(
        [("name", F.col(name)), ("classification", text_or(quality)), ("plavalova_code", text_or(code))]
    )
    return F.concat_ws(", ", first, entity_line(fields))


def context_block(context: Column) -> Column:
    """Indented lines of an ``array<struct<content, similarity>>``; null when there are none."""
    lines = F.transform(
        context,
        lambda r: F.concat(F.lit(CONTEXT_START), r["content"], F.lit(CONTEXT_RELEVANCE), fixed(r["similarity"], 2), F.lit(")")),
    )
    return F.when(
        F.size(context) > 0, F.concat(F.lit(CONTEXT_TITLE + "\n"), F.array_join(lines, "\n"))
    )


def batch_text(
    lines: DataFrame, *, batch: str, position: str, line: str, header: str, footer: str = DEFAULT_FOOTER
) -> DataFrame:
    """One text per batch. A batch holds a fixed number of rows, so its list is bounded."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position), F.col(line).alias("_line"))))
    return lines.groupBy(batch).agg(ordered.alias("_rows")).select(
        batch,
        F.size("_rows").cast("long").alias("entities"),
        F.concat(
            F.lit(header + "\n"),
            F.array_join(F.transform("_rows", lambda r: r["_line"]), "\n"),
            F.lit("\n" + footer + "\n"),
        ).alias("text"),
    )


def variant_texts(texts: DataFrame, *, batch: str, headers: Mapping[str, str]) -> DataFrame:
    """The same batch bodies under every variant's header (a handful of parameters)."""
    variants = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(h).alias("header")) for v, h in headers.items()])
    return texts.select(batch, "text", F.explode(variants).alias("v")).select(
        F.col("v.variant").alias("variant"),
        batch,
        F.concat(F.col("v.header"), F.lit("\n"), F.col("text")).alias("text"),
    )


def change_line(entity: str) -> Column:
    """Report line of a change row."""
    shown = lambda c: F.coalesce(c, F.lit("null"))
    update = F.concat(
        F.lit("UPDATE: "), entity, F.lit(" — "), F.coalesce("field_name", F.lit("")),
        F.lit(": ["), shown("old_value"), F.lit("] → ["), shown("new_value"), F.lit("]"),
    )
    return F.when(F.col("change_type") == "UPDATE", update).otherwise(
        F.concat(F.col("change_type"), F.lit(": "), entity)
    )


def report_text(
    changes: DataFrame,
    *,
    run: str,
    entity: str,
    order: Sequence[str] = ("change_type",),
    sample: int = REPORT_SAMPLE,
    header: str = DEFAULT_REPORT_HEADER,
) -> DataFrame:
    """One text per run: counts by type, the first ``sample`` change lines, the number of others.

    The sample is the feature of the report. Counts are over all rows; the window group limit
    keeps ``sample`` rows per run and task before the shuffle, so a long run stays small.
    """
    count = lambda kind: F.count_if(F.col("change_type") == kind)
    counts = changes.groupBy(run).agg(
        count("INSERT").alias("inserts"),
        count("UPDATE").alias("updates"),
        count("DELETE").alias("deletes"),
        F.count(F.lit(1)).alias("total"),
    )
    by_order = [*order, entity, "field_name"]
    rank = F.row_number().over(Window.partitionBy(run).orderBy(*by_order))
    first = changes.withColumn("_rank", rank).filter(F.col("_rank") <= sample)
    lists = first.groupBy(run).agg(
        F.array_sort(F.collect_list(F.struct("_rank", change_line(entity).alias("_line")))).alias("_rows")
    )
    left_over = F.col("total") - F.lit(sample)
    return counts.join(lists, run).select(
        run,
        "inserts",
        "updates",
        "deletes",
        F.concat(
            F.lit(header + "\n"),
            F.format_string(REPORT_SUMMARY, "inserts", "updates", "deletes"),
            F.lit(REPORT_START.format(sample=sample)),
            F.array_join(F.transform("_rows", lambda r: r["_line"]), "\n"),
            F.when(left_over > 0, F.format_string(REPORT_MORE, left_over)).otherwise(F.lit("")),
            F.lit(REPORT_END),
        ).alias("text"),
    )


def report_record(texts: DataFrame, answers: DataFrame, *, run: str, model: str) -> DataFrame:
    """Audit row per run: text sent, text received (``answers(run, report_text, tokens_used)``)."""
    return texts.join(answers, run).select(
        run,
        F.lit(model).alias("model_used"),
        F.col("text").alias("prompt_sent"),
        "report_text",
        "tokens_used",
    )
