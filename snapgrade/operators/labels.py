"""Answers to labels, labels to change rows, labels to grades.

Sides with a row per entity or change are joined by merge: their columns compress so well that Spark, which
judges by the files' size, would send them whole through the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from snapgrade.functions import rules
from snapgrade.functions.text import key_of_name, strip_fences
from snapgrade.operators.dedupe import first_per_key
from snapgrade.session import materialise


@dataclass(frozen=True)
class AnswerField:
    """One key of an answer element.

    ``required``: the key must be there. ``nullable``: a JSON null is allowed. ``default``
    stands for a null or missing value. ``keep_null``: without a value the element is left out.
    """

    name: str
    kind: str = "string"
    required: bool = False
    nullable: bool = True
    default: str | int | None = None
    keep_null: bool = True


# The element formats of the answer kinds.
NAME_FIELD = AnswerField("planet_name", required=True, keep_null=False)
LABEL_FIELDS = (
    NAME_FIELD,
    AnswerField("classification", required=True, keep_null=False),
    AnswerField("reasoning", required=True, default=""),
    AnswerField("plavalova_code"),
)
JUDGE_FIELDS = (
    NAME_FIELD,
    AnswerField("score", kind="int", required=True, nullable=False),
    AnswerField("reasoning", default=""),
)
CODE_FIELDS = (NAME_FIELD, AnswerField("plavalova_code", keep_null=False))
NOTE_FIELDS = (
    NAME_FIELD,
    AnswerField("classification", default=""),
    AnswerField("plavalova_code", default=""),
    AnswerField("scientific_note", default=""),
)

# What schema_of_variant names a JSON value of the wanted kind; VOID is a JSON null.
_KIND_NAMES = {"string": "STRING", "int": "BIGINT"}

OK, EMPTY_TEXT, MALFORMED, BROKEN = "ok", "no_text", "malformed", "broken_element"


def _typed_elements(answers: DataFrame, keys: Sequence[str], text: str, fields: Sequence[AnswerField]) -> DataFrame:
    """``keys, status, position``, the fields and ``broken``: one row per element, and one row
    with a null position for a text without any.

    Elements are exploded before they are looked into: each field is then fetched once per row
    in generated code, and the window that finds an answer's broken elements spans only the
    elements of one text.
    """
    body = strip_fences(F.col(text))
    parsed = F.when(body.startswith("[") & body.endswith("]"), F.try_parse_json(body))
    elements = answers.select(
        *keys, F.col(text).isNull().alias("_no_text"), F.try_variant_get(parsed, "$", "array<variant>").alias("_all")
    ).select(*keys, "_no_text", F.col("_all").isNull().alias("_no_array"), F.posexplode_outer("_all").alias("position", "_e"))

    # each field is looked up once; its kind and its value come from what was found
    found = elements.select("*", *[F.try_variant_get("_e", f"$.{f.name}", "variant").alias(f"_found_{f.name}") for f in fields])
    values = found.select(
        *keys, "_no_text", "_no_array", "position",
        *[F.schema_of_variant(f"_found_{f.name}").alias(f"_{f.name}") for f in fields],
        *[F.try_variant_get(f"_found_{f.name}", "$", f.kind).alias(f"_value_{f.name}") for f in fields],
    ).select(
        *keys, "_no_text", "_no_array", "position", *[f"_{f.name}" for f in fields],
        *[F.when(F.col(f"_{f.name}") == _KIND_NAMES[f.kind], F.col(f"_value_{f.name}")).alias(f.name) for f in fields],
    )

    def fault(field: AnswerField) -> Column:
        kind, wanted = F.col(f"_{field.name}"), _KIND_NAMES[field.kind]
        found = (kind.isNotNull() & ~kind.isin(wanted, "VOID")) | ((kind == wanted) & F.col(field.name).isNull())
        if field.required:
            found = found | kind.isNull()
        if not field.nullable:
            found = found | (kind == "VOID")
        return F.coalesce(found, F.lit(False))

    # an element that is no object has no name, which is a fault of the required name field
    broken = reduce(lambda a, b: a | b, [fault(f) for f in fields])
    judged = values.select(
        *keys, "_no_text", "_no_array", "position", *[f.name for f in fields],
        (F.col("position").isNotNull() & broken).alias("broken"),
    )
    any_broken = F.max("broken").over(Window.partitionBy(*keys))
    status = (
        F.when(F.col("_no_text"), EMPTY_TEXT)
        .when(F.col("_no_array"), MALFORMED)
        .when(any_broken, BROKEN)
        .otherwise(OK)
    )
    return judged.withColumn("status", status).drop("_no_text", "_no_array")


def parse_answers(
    answers: DataFrame,
    keys: Sequence[str],
    text: str,
    fields: Sequence[AnswerField],
    *,
    on_broken: str = "void_answer",
) -> DataFrame:
    """One row per answer and entity: ``keys, name_key, position`` and the fields.

    ``keys`` identify an answer. Names are matched regardless of case and the last element of a
    repeated name wins. A malformed text gives no rows. An element that lacks a required key or
    holds a value of another kind voids its whole answer, or with
    ``on_broken="skip_element"`` only itself.
    """
    if on_broken not in ("void_answer", "skip_element"):
        raise ValueError("on_broken must be 'void_answer' or 'skip_element'")
    rows = _typed_elements(answers, keys, text, fields)
    rows = rows.filter(F.col("status") == OK) if on_broken == "void_answer" else rows.filter(~F.col("broken"))
    rows = rows.filter(F.col("position").isNotNull())
    for field in fields:
        if not field.keep_null:
            rows = rows.filter(F.col(field.name).isNotNull())
    rows = rows.drop("broken", "status").withColumn("name_key", key_of_name(F.col(NAME_FIELD.name)))
    rows = first_per_key(rows, [*keys, "name_key"], [F.col("position").desc()])
    defaults = {f.name: F.coalesce(f.name, F.lit(f.default)) for f in fields if f.default is not None}
    return rows.withColumns(defaults) if defaults else rows


def answer_status(answers: DataFrame, keys: Sequence[str], text: str, fields: Sequence[AnswerField]) -> DataFrame:
    """Per answer: status, number of elements and of broken elements."""
    return _typed_elements(answers, keys, text, fields).groupBy(*keys, "status").agg(
        F.count("position").alias("elements"), F.count_if("broken").alias("broken")
    )


def labels_from_answers(parsed: DataFrame) -> DataFrame:
    """Composite label and reason per answer row."""
    return parsed.withColumn(
        "label", rules.join_label(F.col("classification"), F.col("plavalova_code"))
    ).withColumnRenamed("reasoning", "reason")


def previous_value(
    df: DataFrame, group: str, order: str, value: str, output: str, span: int = 1000
) -> DataFrame:
    """``lag(value) over (partition by group order by order)`` in two levels.

    ``order`` is a whole number, unique per group. The rows of a group are cut into spans of
    the order, so that no window holds more than ``span`` rows of one group; the last value of
    a span is carried into the next non-empty span by a window over one row per span.
    """
    spanned = df.withColumn("_span", F.floor(F.col(order) / F.lit(span)).cast("long"))
    wrapped = F.struct(F.col(value).alias("v"))
    last = spanned.groupBy(group, "_span").agg(F.max_by(wrapped, order).alias("_last"))
    carry = last.select(
        group, "_span", F.lag("_last").over(Window.partitionBy(group).orderBy("_span")).alias("_carry")
    )
    inside = F.lag(wrapped).over(Window.partitionBy(group, "_span").orderBy(order))
    return (
        spanned.withColumn("_inside", inside)
        .join(carry.hint("merge"), [group, "_span"])
        .withColumn(output, F.coalesce("_inside", "_carry")["v"])
        .drop("_inside", "_carry", "_span")
    )


@dataclass(frozen=True)
class AppliedLabels:
    """Rows to append to the change log, and the entities' next state."""

    changes: DataFrame
    entities: DataFrame


def apply_labels(
    changes: DataFrame,
    labels: DataFrame,
    entities: DataFrame,
    *,
    name: str = "planet_name",
    batch: str = "batch",
    seq: str = "seq",
    label: str = "classification",
    updated: str | None = None,
    now: Column | None = None,
) -> AppliedLabels:
    """Set labels once per change row.

    ``changes(name, batch, seq, …)``, ``labels(batch, name_key, label, reason)`` unique per
    (batch, name_key), ``entities(name, label column, …)`` unique per name. A name with n
    change rows in labelled batches gets n rows; the first carries the stored label as old
    value, each later one the label set just before it. Within a (name, batch) group the label
    is one value, so only the first row of each group looks back, and looking back runs over
    one row per group instead of over the change rows. The groups are read by both results
    and written once.
    """
    now = F.current_timestamp() if now is None else now
    named = changes.select(name, batch, seq)
    groups = named.groupBy(name, batch).agg(F.min(seq).alias("_first"))
    labelled = materialise(
        groups.withColumn("name_key", key_of_name(F.col(name)))
        .join(labels.select(batch, "name_key", F.col("label").alias("_label"), "reason").hint("merge"), [batch, "name_key"])
        .join(entities.select(name, F.col(label).alias("_stored")).hint("merge"), name),
        "labelled",
    )
    chained = previous_value(labelled, name, batch, "_label", "_before")
    before = F.coalesce("_before", "_stored")
    per_group = chained.select(name, batch, "_first", "_label", "reason", before.alias("_old"))
    final = labelled.groupBy(name).agg(F.max_by("_label", batch).alias("_final"))
    rows = named.join(per_group.hint("merge"), [name, batch]).select(
        name,
        batch,
        seq,
        F.lit("UPDATE").alias("change_type"),
        F.lit("classification").alias("field_name"),
        F.when(F.col(seq) == F.col("_first"), F.col("_old")).otherwise(F.col("_label")).alias("old_value"),
        F.col("_label").alias("new_value"),
        F.col("_label").alias("ai_classification"),
        F.col("reason").alias("ai_reasoning"),
    )
    state = entities.join(final.hint("merge"), name, "left")
    replaced = {label: F.coalesce("_final", label)}
    if updated:
        replaced[updated] = F.when(F.col("_final").isNotNull(), now).otherwise(F.col(updated))
    return AppliedLabels(rows, state.withColumns(replaced).select(*entities.columns))


def labelled_names(changes: DataFrame, name: str = "planet_name") -> DataFrame:
    """Names that got a label row."""
    return changes.filter(F.col("field_name") == "classification").select(name).distinct()


def labelled_entities(
    entities: DataFrame, changes: DataFrame, name: str = "planet_name", label: str = "classification"
) -> DataFrame:
    """Entities with a label that was set in these change rows."""
    return entities.filter(F.col(label).isNotNull()).join(labelled_names(changes, name).hint("merge"), name, "left_semi")


def grade_labels(
    entities: DataFrame,
    *,
    name: str,
    label: str,
    expected_label: Column,
    expected_code: Column,
) -> DataFrame:
    """Two grade rows per labelled entity: the label's accuracy, and the code's.

    One pass: both rows come from one ``explode``. An entity without a code gets a
    completeness row with score 0.
    """
    actual_label, actual_code = rules.split_label(F.col(label))
    base = entities.select(
        F.col(name),
        actual_label.alias("_label"),
        actual_code.alias("_code"),
        expected_label.alias("_want_label"),
        expected_code.alias("_want_code"),
    )
    label_score = rules.equality_score(F.col("_want_label"), F.col("_label"))
    code_score = F.when(
        F.col("_code").isNotNull(), rules.component_score(F.col("_want_code"), F.col("_code"))
    ).otherwise(0)
    row = lambda kind, want, got, score, dimension, mark: F.struct(
        F.lit(kind).alias("eval_type"),
        F.col(want).alias("expected_value"),
        F.col(got).alias("actual_value"),
        score.alias("score"),
        dimension.alias("dimension"),
        rules.pass_fail(score, mark).alias("pass_fail"),
    )
    code_dimension = F.when(F.col("_code").isNotNull(), F.lit("accuracy")).otherwise(F.lit("completeness"))
    both = F.array(
        row("CLASSIFICATION", "_want_label", "_label", label_score, F.lit("accuracy"), 100),
        row("PLAVALOVA", "_want_code", "_code", code_score, code_dimension, rules.CODE_PASS_MARK),
    )
    return base.select(name, F.explode(both).alias("grade")).select(name, "grade.*")


def judge_rows(entities: DataFrame, judgments: DataFrame, *, name: str, batch: str | None = None) -> DataFrame:
    """One grade row per entity that has a judgment ``(name_key, score, reasoning)``.

    With ``batch`` both sides carry it, and only the answer to an entity's own batch counts.
    """
    points = rules.clamp_score(F.col("score"))
    keys = ["name_key"] if batch is None else [batch, "name_key"]
    return (
        entities.withColumn("name_key", key_of_name(F.col(name)))
        .select(name, *keys)
        .join(judgments.select(*keys, "score", "reasoning").hint("merge"), keys)
        .select(
            name,
            F.lit("LLM_JUDGE").alias("eval_type"),
            F.lit(None).cast("string").alias("expected_value"),
            F.concat(
                F.lit("score="), points.cast("string"), F.lit(rules.SEPARATOR), F.coalesce("reasoning", F.lit(""))
            ).alias("actual_value"),
            rules.scaled_score(F.col("score")).alias("score"),
            F.lit("reasoning").alias("dimension"),
            rules.pass_fail(points, rules.JUDGE_PASS_MARK).alias("pass_fail"),
        )
    )


def grade_summary(grades: DataFrame, groups: Sequence[str] = ("eval_type",)) -> DataFrame:
    """Passes, rows and average score (0 when there is none) per group."""
    return grades.groupBy(*groups).agg(
        F.count_if(F.col("pass_fail") == "PASS").alias("passed"),
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"),
    )


def compare_label_sets(
    entities: DataFrame, left: DataFrame, right: DataFrame, *, name: str, columns: Mapping[str, str]
) -> DataFrame:
    """Both sets' values side by side per entity.

    ``left``/``right`` have one row per ``name_key``; ``columns`` maps a value column to its
    default where the entity has no row. ``<column>_match`` says Same or DIFF.
    """
    def side(df: DataFrame, suffix: str) -> DataFrame:
        return df.select("name_key", *[F.col(c).alias(f"{c}_{suffix}") for c in columns])

    joined = (
        entities.select(name, key_of_name(F.col(name)).alias("name_key"))
        .join(side(left, "without"), "name_key", "left")
        .join(side(right, "with"), "name_key", "left")
    )
    out = [F.col(name)]
    for column, default in columns.items():
        a = F.coalesce(f"{column}_without", F.lit(default))
        b = F.coalesce(f"{column}_with", F.lit(default))
        out += [
            a.alias(f"{column}_without"),
            b.alias(f"{column}_with"),
            F.when(a == b, F.lit("Same")).otherwise(F.lit("DIFF")).alias(f"{column}_match"),
        ]
    return joined.select(*out)
