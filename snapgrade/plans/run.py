"""Whole runs as driver functions over tables in one base folder.

Every stage reads tables and writes tables. What a stage leaves is committed as a whole and replaced
when the same stage runs again, so a failed run can be repeated from any stage.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from snapgrade import schemas
from snapgrade.functions.text import content_text
from snapgrade.operators import cell_index, checks, drift, labels as label_ops, ledger, retrieval, texts
from snapgrade.operators.answers import ask_missing
from snapgrade.operators.batches import assign_batches
from snapgrade.operators.dedupe import GroupedPairs, clean_keys, first_per_key
from snapgrade.operators.diff import (
    carried_columns, changes_of, counts_of, pair_snapshots, run_result, state_of,
)
from snapgrade.operators.dims import SnapshotLayout, clean_snapshot, normalise_snapshot
from snapgrade.session import materialise
from snapgrade.sources.landed import new_references
from snapgrade.sources.sinks import read_evidence, replace_stage

Ask = Callable[[DataFrame], DataFrame]

# Batch sizes.
LABEL_BATCH, JUDGE_BATCH, REFERENCE_BATCH = 50, 50, 100

TABLES = {
    "ingest_run": schemas.INGEST_RUN,
    "change_log": schemas.CHANGE_LOG,
    "change_report": schemas.CHANGE_REPORT,
    "eval_result": schemas.EVAL_RESULT,
    "drift_verdict": schemas.DRIFT_VERDICT,
    "retrieval_log": schemas.RETRIEVAL_LOG,
    "references": schemas.REFERENCES,
    "solar_systems": schemas.SOLAR_SYSTEMS,
    "stars": schemas.STARS,
    "planets": schemas.PLANETS,
    "planet_stars": schemas.PLANET_STARS,
}


@dataclass(frozen=True)
class RunTables:
    """Evidence tables and states of one base path."""

    base: str

    def write(self, df: DataFrame, table: str, run_id: int, stage: str) -> None:
        replace_stage(df, f"{self.base}/{table}", TABLES[table], run_id, stage)

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """Rows of all runs; no rows before the first write."""
        return read_evidence(spark, f"{self.base}/{table}", TABLES[table])

    def of_run(self, spark: SparkSession, table: str, run_id: int) -> DataFrame:
        return self.read(spark, table).filter(F.col("ingest_run_id") == run_id)

    def before(self, spark: SparkSession, table: str, run_id: int) -> DataFrame:
        """What earlier runs stored: the same whether this run is the first try or a repeat."""
        return self.read(spark, table).filter(F.col("ingest_run_id") < run_id)

    def state_path(self, run_id: int, name: str = "state") -> str:
        return f"{self.base}/{name}/run={run_id}"

    def answers_path(self) -> str:
        return f"{self.base}/answers"

    def asking(self, ask: Ask, task: str, model: str | None, at: Column) -> Ask:
        """``ask`` for texts without a kept answer; without a model's name for all, and nothing is kept."""
        if model is None:
            return ask
        return lambda sent: ask_missing(sent, self.answers_path(), ask, model=f"{task}:{model}", at=at)

    def index_path(self) -> str:
        return f"{self.base}/reference_cells"


def ingest(
    spark: SparkSession,
    tables: RunTables,
    run_id: int,
    stored: DataFrame,
    incoming: DataFrame,
    *,
    keys: Sequence[str],
    required: Sequence[str] = (),
    fields: Sequence[str],
    order: Sequence[str],
    at: Column,
    source: str = "landed",
    entity_filter: Column | None = None,
    created: str | None = None,
    updated: str | None = None,
) -> DataFrame:
    """Clean, diff, write the change log, the next state and the ledger; give the run counters.

    ``entity_filter`` optionally restricts the incoming rows (off by default: a restricted
    snapshot reports every other stored key as deleted). The incoming side is read once, its rows
    counted on the way. The paired rows are written once: the change log, the next state and the
    counters read that table instead of joining again. Stored keys must be unique: a repeated one
    would multiply its rows in every later state. ``created`` and ``updated`` name audit columns.
    """
    if entity_filter is not None:
        incoming = incoming.filter(F.coalesce(entity_filter, F.lit(False)))
    opened = ledger.open_run(spark, run_id, source, None, None, at)
    tables.write(opened, "ingest_run", run_id, "open")
    try:
        checks.require_unique(stored.select(*keys), keys)
        seen = Observation()
        counted = incoming.observe(seen, F.count(F.lit(1)).alias("fetched"))
        cleaned = first_per_key(clean_keys(counted, [*keys, *required]), keys, list(order))
        pair_path = tables.state_path(run_id, "paired")
        pair_snapshots(
            stored, cleaned, keys, fields, carry=carried_columns(stored, keys, fields)
        ).write.mode("overwrite").parquet(pair_path)
        fetched = seen.get["fetched"]
        paired = spark.read.parquet(pair_path)
        changes = changes_of(paired, keys).withColumnRenamed(keys[0], "planet_name").withColumn("detected_at", at)
        tables.write(changes, "change_log", run_id, "diff")
        state_of(paired, stored.schema, keys, fields, now=at, created=created, updated=updated).write.mode(
            "overwrite"
        ).parquet(tables.state_path(run_id))
        counts = counts_of(paired)
        closed = ledger.complete_run(opened.withColumn("rows_fetched", F.lit(fetched).cast("long")), counts, at)
        tables.write(closed, "ingest_run", run_id, "close")
    except Exception as error:
        tables.write(ledger.fail_run(opened, str(error), at), "ingest_run", run_id, "close")
        raise
    return run_result(spark.range(1).select(F.lit(fetched).cast("long").alias("fetched")), counts)


def catalogue(
    spark: SparkSession, tables: RunTables, run_id: int, incoming: DataFrame, layout: SnapshotLayout, *, at: Column
) -> None:
    """Add the snapshot's new systems, stars, planets and links to the four tables."""
    new = normalise_snapshot(
        clean_snapshot(incoming, layout),
        layout,
        *(tables.before(spark, t, run_id) for t in ("stars", "planets", "planet_stars")),
    )
    frames = {"solar_systems": new.systems, "stars": new.stars, "planets": new.planets, "planet_stars": new.links}
    for table, rows in frames.items():
        tables.write(rows.withColumns({"created_utc": at, "updated_utc": at}), table, run_id, "catalogue")


def store_references(
    spark: SparkSession, tables: RunTables, run_id: int, rows: DataFrame, ask_vectors: Ask, *, at: Column, **content
) -> None:
    """Store the references that no earlier run stored, with the vectors of their content.

    ``ask_vectors`` takes ``(batch, position, content)`` and gives ``(batch, position, embedding)``. The
    references also become a load of the stored cell index.
    """
    stored = tables.before(spark, "references", run_id)
    fresh = materialise(load_references(rows, stored, **content), "references")
    vectors = ask_vectors(fresh.select("batch", "position", "content"))
    found = fresh.join(vectors.select("batch", "position", "embedding"), ["batch", "position"])
    named = found.withColumns({"id": F.xxhash64("planet_name", "reference_name"), "created_utc": at})
    tables.write(named, "references", run_id, "references")
    index_references(spark, tables, run_id)


def _vectors(references: DataFrame) -> DataFrame:
    return references.select(F.col("id").alias("ref_id"), F.col("embedding").alias("vector"))


def index_references(spark: SparkSession, tables: RunTables, run_id: int) -> None:
    """Put a run's references into the cell index, in place of an earlier attempt's.

    The first run that has a vector creates the index; until then nothing is indexed.
    """
    stored = tables.of_run(spark, "references", run_id)
    base = tables.index_path()
    if not cell_index.exists(spark, base):
        if stored.where(F.col("embedding").isNotNull()).isEmpty():
            return
        cell_index.create(spark, base, _vectors(stored))
    cell_index.append(spark, base, _vectors(stored), run_id)


def retrieve(
    spark: SparkSession, tables: RunTables, run_id: int, questions: DataFrame, *, name: str, at: Column,
    k: int = retrieval.TOP_K, **how,
) -> DataFrame:
    """Log the nearest stored references of each question ``(name, vector)``; give ``(name, context)``.

    By default the stored cell index is searched, which reads the cells that questions are sent to; runs
    whose references it lacks are added first. ``how`` names another way, as for ``topk_cosine``.
    """
    stored = tables.read(spark, "references").filter(F.col("ingest_run_id") <= run_id)
    asked = questions.select(F.col(name).alias("query_id"), "vector")
    if how:
        found = retrieval.topk_cosine(asked, _vectors(stored), k, **how)
    else:
        indexed = cell_index.loads(spark, tables.index_path())
        for r in stored.select("ingest_run_id").distinct().orderBy("ingest_run_id").collect():  # one row per run
            if r.ingest_run_id not in indexed:
                index_references(spark, tables, r.ingest_run_id)
        found = cell_index.search(spark, tables.index_path(), asked, k, upto=run_id)
    found = materialise(found, "retrieved")
    named = stored.select(F.col("id").alias("ref_id"), "reference_name", "content")
    log = retrieval.retrieval_log(found, named, run_id=run_id, entity="query_id").withColumn("retrieved_at", at)
    tables.write(log, "retrieval_log", run_id, "retrieval")
    return retrieval.context_lists(found, named, entity="query_id").withColumnRenamed("query_id", name)


def change_batches(changes: DataFrame, *, name: str, size: int = LABEL_BATCH) -> DataFrame:
    """Change rows of a run in label batches, ordered by type, name and field."""
    return assign_batches(
        changes.select(name, "change_type", "field_name"),
        ["change_type", name, "field_name"],
        size,
        position="seq",
    )


def label(
    spark: SparkSession,
    tables: RunTables,
    run_id: int,
    entities: DataFrame,
    batches: DataFrame,
    answers: DataFrame,
    *,
    name: str,
    at: Column,
    label_column: str = "classification",
    updated: str | None = None,
) -> DataFrame:
    """Parse the answers of a run's batches (``batch, text``), log label rows, give the new state."""
    parsed = label_ops.labels_from_answers(
        label_ops.parse_answers(answers, ["batch"], "text", label_ops.LABEL_FIELDS)
    )
    applied = label_ops.apply_labels(
        batches, parsed, entities, name=name, label=label_column, updated=updated, now=at
    )
    rows = applied.changes.withColumnRenamed(name, "planet_name").withColumn("detected_at", at)
    tables.write(rows, "change_log", run_id, "label")
    return applied.entities


def label_rows(spark: SparkSession, tables: RunTables, run_id: int, name: str) -> DataFrame:
    """The label rows of a run's change log."""
    log = tables.of_run(spark, "change_log", run_id).filter(F.col("stage") == "label")
    return log.withColumnRenamed("planet_name", name)


def grade(
    tables: RunTables,
    run_id: int,
    entities: DataFrame,
    labelled_rows: DataFrame,
    *,
    name: str,
    at: Column,
    label_column: str = "classification",
    expected_label: Column,
    expected_code: Column,
) -> None:
    """Write the grade rows of the entities labelled in this run."""
    labelled = label_ops.labelled_entities(entities, labelled_rows, name, label_column)
    rows = label_ops.grade_labels(
        labelled, name=name, label=label_column, expected_label=expected_label, expected_code=expected_code
    )
    tables.write(_dated(rows, name, at), "eval_result", run_id, "grade")


def _dated(rows: DataFrame, name: str, at: Column) -> DataFrame:
    return rows.withColumnRenamed(name, "planet_name").withColumn("evaluated_at", at)


def check_drift(spark: SparkSession, tables: RunTables, run_id: int) -> DataFrame:
    states = ledger.latest_run_states(tables.read(spark, "ingest_run"))
    runs = states.select(F.col("id").alias("ingest_run_id"), "status")
    return drift.drift_check(tables.read(spark, "eval_result"), runs, run_id)


def label_texts(
    batches: DataFrame, entities: DataFrame, *, name: str, line: Column, context: DataFrame | None = None,
    header: str = texts.DEFAULT_CLASSIFY_HEADER,
) -> DataFrame:
    """Texts of the label batches: every change row's entity, with its context if it has any.

    Change rows without an entity drop out, repeated entities stay. ``context(name, context)``.
    """
    # by merge: see operators.labels
    lines = batches.select(name, "batch", "seq").join(entities.hint("merge"), name)
    if context is not None:
        lines = lines.join(context.hint("merge"), name, "left")
        line = F.concat_ws("\n", line, texts.context_block(F.col("context")))
    return texts.batch_text(
        lines.select("batch", "seq", line.alias("line")), batch="batch", position="seq", line="line", header=header
    )


def report(
    spark: SparkSession, tables: RunTables, run_id: int, ask: Ask, *, at: Column, model: str = "external"
) -> None:
    """Write the report record of a run over all its change rows, labels included.

    ``ask`` turns the text sent into ``(ingest_run_id, report_text, tokens_used)``.
    """
    changes = tables.of_run(spark, "change_log", run_id)
    sent = texts.report_text(changes, run="ingest_run_id", entity="planet_name")
    record = texts.report_record(sent, ask(sent), run="ingest_run_id", model=model)
    tables.write(record.withColumn("generated_at", at), "change_report", run_id, "report")


def judge(
    tables: RunTables, run_id: int, entities: DataFrame, labelled_rows: DataFrame, ask: Ask, *, name: str, at: Column,
    label_column: str = "classification", line: Column, header: str = texts.DEFAULT_JUDGE_HEADER,
) -> None:
    """Have the labels of a run judged in batches, and write the judge rows."""
    labelled = label_ops.labelled_entities(entities, labelled_rows, name, label_column)
    placed = assign_batches(labelled, [name], JUDGE_BATCH, position="seq")
    sent = texts.batch_text(
        placed.select("batch", "seq", line.alias("line")), batch="batch", position="seq", line="line", header=header
    )
    judgments = label_ops.parse_answers(ask(sent), ["batch"], "text", label_ops.JUDGE_FIELDS)
    rows = label_ops.judge_rows(placed, judgments, name=name, batch="batch")
    tables.write(_dated(rows, name, at), "eval_result", run_id, "judge")


def whole_run(
    spark: SparkSession,
    tables: RunTables,
    run_id: int,
    stored: DataFrame,
    incoming: DataFrame,
    *,
    name: str,
    required: Sequence[str] = (),
    fields: Sequence[str],
    order: Sequence[str],
    at: Column,
    label_line: Column,
    judge_line: Column,
    expected_label: Column,
    expected_code: Column,
    ask_labels: Ask,
    ask_report: Ask,
    ask_judge: Ask,
    created: str | None = None,
    updated: str | None = None,
    layout: SnapshotLayout | None = None,
    references: DataFrame | None = None,
    ask_vectors: Ask | None = None,
    question_vectors: Callable[[DataFrame], DataFrame] | None = None,
    context: DataFrame | None = None,
    keep_answers: str | None = None,
) -> DataFrame:
    """Ingest, catalogue, references, retrieval, label, report, grade, drift, judge; gives the run counters.

    The ``ask_*`` hooks turn a table of texts into a table of answers: that is where a remote
    model is called, outside this library. ``layout`` adds the catalogue tables,
    ``references`` with ``ask_vectors`` the reference load, and ``question_vectors`` (from the
    changed entities to ``name, vector``) the retrieval that gives the label texts their context.
    ``keep_answers`` names the model: label and judge answers are then stored by the text they were
    asked with, and a repeated, resumed or later run asks only texts without an answer.
    A run without changes is not labelled and has no report; its drift row is written all the same.
    """
    result = ingest(
        spark, tables, run_id, stored, incoming, keys=[name], required=required, fields=fields, order=order, at=at,
        created=created, updated=updated,
    )
    if layout is not None:
        catalogue(spark, tables, run_id, incoming, layout, at=at)
    if references is not None:
        store_references(spark, tables, run_id, references, ask_vectors, at=at)
    state = spark.read.schema(stored.schema).parquet(tables.state_path(run_id))
    changes = tables.of_run(spark, "change_log", run_id).filter(F.col("stage") == "diff")
    changes = changes.withColumnRenamed("planet_name", name)
    changed = not changes.isEmpty()
    if changed and question_vectors is not None:
        touched = state.join(changes.select(name).distinct(), name, "left_semi")
        context = retrieve(spark, tables, run_id, question_vectors(touched), name=name, at=at)
    batches = materialise(change_batches(changes, name=name), "batches")
    sent = label_texts(batches, state, name=name, line=label_line, context=context)
    ask_labels = tables.asking(ask_labels, "label", keep_answers, at)
    ask_judge = tables.asking(ask_judge, "judge", keep_answers, at)
    answers = ask_labels(sent) if changed else sent.select("batch", "text").filter(F.lit(False))
    labelled_path = tables.state_path(run_id, "labelled")
    entities = label(spark, tables, run_id, state, batches, answers, name=name, at=at, updated=updated)
    entities.write.mode("overwrite").parquet(labelled_path)
    labelled = spark.read.schema(stored.schema).parquet(labelled_path)
    if changed:
        report(spark, tables, run_id, ask_report, at=at)
    log = label_rows(spark, tables, run_id, name)
    grade(tables, run_id, labelled, log, name=name, at=at, expected_label=expected_label, expected_code=expected_code)
    tables.write(check_drift(spark, tables, run_id), "drift_verdict", run_id, "drift")
    judge(tables, run_id, labelled, log, ask_judge, name=name, at=at, line=judge_line)
    return result


def load_references(
    rows: DataFrame,
    stored: DataFrame | GroupedPairs,
    *,
    order: Sequence[str] = ("source_file", "source_row"),
    measures: Sequence[tuple[str, str, int, str]] = (),
    method: str | None = None,
    size: int = REFERENCE_BATCH,
) -> DataFrame:
    """New references with content text, in embedding batches; the vectors are joined later."""
    fresh = new_references(rows, stored, order)
    content = content_text(
        F.col("raw_name"),
        F.col("raw_reference"),
        F.col(method) if method else None,
        [(label_, F.col(c), decimals, unit) for label_, c, decimals, unit in measures],
    )
    rows = fresh.select(
        "planet_name", "reference_name", F.coalesce("pub_date", F.lit("")).alias("pub_date"), content.alias("content")
    )
    return assign_batches(rows, ["planet_name", "reference_name"], size)
