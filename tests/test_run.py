"""Whole runs on hand-made rows: repeats, no changes, broken answers, and the catalogue and reference stages."""

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows
from snapgrade.operators import labels as label_ops, texts
from snapgrade.operators.dims import SnapshotLayout
from snapgrade.plans import run as runs

STORED = "name string, host string, mass double, classification string, created timestamp, updated timestamp"
SNAPSHOT = "row int, name string, host string, mass double"
FIRST = [(1, "a", "s1", 1.0), (2, "b", "s1", 2.0), (3, "c", " ", 3.0), (4, "d ", "s2", None)]


def answer(element, broken=False):
    lines = F.regexp_extract_all("text", F.lit(r"(?m)^(name=.*)$"), 1)
    array = F.concat(F.lit("["), F.array_join(F.transform(lines, element), ","), F.lit("]"))
    return lambda sent: sent.select("batch", (F.lit("no json") if broken else array).alias("text"))


def element(rest):
    return lambda line: F.concat(F.lit('{"planet_name": "'), F.regexp_extract(line, "name=([^,]+)", 1), F.lit('", ' + rest + "}"))


def go(spark, tables, run_id, stored, snapshot, broken=False, **more):
    label = element('"classification": "CONFIRMED", "reasoning": "r", "plavalova_code": "mFtg"')
    fields = (("name", "name", None), ("mass", "mass", 2))
    asks = {"ask_labels": answer(label, broken), "ask_judge": answer(element('"score": 8'), broken), **more}
    return runs.whole_run(
        spark, tables, run_id, stored, spark.createDataFrame(snapshot, SNAPSHOT), name="name", required=["host"],
        fields=["host", "mass"], order=["row"], at=F.lit(f"2024-01-0{run_id} 00:00:00").cast("timestamp"),
        label_line=texts.entity_line(fields), judge_line=texts.judge_line("name", "classification", fields[1:]),
        expected_label=F.lit("CONFIRMED"), expected_code=F.lit("mFtg"),
        created="created", updated="updated",
        ask_report=lambda sent: sent.select("ingest_run_id", F.lit("ok").alias("report_text"), F.lit(1).alias("tokens_used")),
        **asks,
    ).first()


@pytest.fixture
def tables(tmp_path):
    return runs.RunTables(str(tmp_path / "run"))


def state(spark, tables, run_id):
    return spark.read.parquet(tables.state_path(run_id, "labelled"))


def counts(spark, tables):
    return {t: tables.read(spark, t).count() for t in ("ingest_run", "change_log", "change_report", "eval_result", "drift_verdict")}


def test_first_run_and_its_repeat(spark, tables):
    stored = spark.createDataFrame([("b", "s1", 9.0, None, None, None)], STORED)
    result = go(spark, tables, 1, stored, FIRST)
    assert (result.fetched, result.valid_incoming, result.inserted, result.updated) == (4, 3, 2, 1)
    log = tables.read(spark, "change_log")
    assert rows(log.select("planet_name", "change_type", "field_name", "old_value", "new_value", "stage")) == [
        ("a", "INSERT", None, None, None, "diff"), ("a", "UPDATE", "classification", None, "CONFIRMED|mFtg", "label"),
        ("b", "UPDATE", "classification", None, "CONFIRMED|mFtg", "label"), ("b", "UPDATE", "mass", "9", "2", "diff"),
        ("d", "INSERT", None, None, None, "diff"), ("d", "UPDATE", "classification", None, "CONFIRMED|mFtg", "label"),
    ]
    assert log.filter("detected_at is null").isEmpty()
    after = state(spark, tables, 1).select("name", "mass", "classification", F.dayofmonth("created"), F.dayofmonth("updated"))
    assert rows(after) == [
        ("a", 1.0, "CONFIRMED|mFtg", 1, 1), ("b", 2.0, "CONFIRMED|mFtg", None, 1), ("d", None, "CONFIRMED|mFtg", 1, 1),
    ]
    report = tables.read(spark, "change_report").first()
    assert "Summary: 2 inserts, 4 updates, 0 deletes" in report.prompt_sent and report.generated_at is not None
    assert tables.read(spark, "drift_verdict").first().verdict == "first_run"
    once = counts(spark, tables)
    assert once == {"ingest_run": 2, "change_log": 6, "change_report": 1, "eval_result": 9, "drift_verdict": 1}
    go(spark, tables, 1, stored, FIRST)
    assert counts(spark, tables) == once


def test_a_run_without_changes_still_has_its_drift_row(spark, tables):
    go(spark, tables, 1, spark.createDataFrame([], STORED), FIRST)
    result = go(spark, tables, 2, state(spark, tables, 1), FIRST)
    assert (result.inserted, result.updated, result.valid_incoming) == (0, 0, 3)
    assert tables.of_run(spark, "change_log", 2).isEmpty() and tables.of_run(spark, "change_report", 2).isEmpty()
    assert [r.verdict for r in tables.of_run(spark, "drift_verdict", 2).collect()] == ["no_score"]
    assert rows(state(spark, tables, 2)) == rows(state(spark, tables, 1))


def test_broken_answers_leave_no_labels_and_no_score(spark, tables):
    go(spark, tables, 1, spark.createDataFrame([], STORED), FIRST, broken=True)
    assert tables.read(spark, "eval_result").isEmpty()
    assert tables.read(spark, "drift_verdict").first().verdict == "no_score"
    assert tables.read(spark, "change_log").select("stage").distinct().collect() == [("diff",)]


def test_stored_keys_must_be_unique_and_errors_are_kept_whole(spark, tables):
    twice = spark.createDataFrame([("a", "s", 1.0, None, None, None)] * 2, STORED)
    with pytest.raises(ValueError, match="duplicate keys"):
        go(spark, tables, 1, twice, FIRST)
    closed = tables.read(spark, "ingest_run").filter("stage = 'close'").first()
    assert closed.status == "FAILED" and "duplicate keys" in closed.error_message
    long = "x" * 5000
    bad = spark.createDataFrame(FIRST, SNAPSHOT).withColumn("mass", F.raise_error(F.lit(long)).cast("double"))
    with pytest.raises(Exception):
        runs.ingest(
            spark, tables, 2, spark.createDataFrame([], STORED), bad, keys=["name"], fields=["host", "mass"], order=["row"],
            at=F.current_timestamp(),
        )
    assert long in tables.read(spark, "ingest_run").filter("id = 2 and stage = 'close'").first().error_message


def test_catalogue_references_and_retrieval(spark, tables):
    layout = SnapshotLayout(planet_key="name", host_key="host", order=["row"], planet_fields=[], system_fields={}, star_fields={})
    references = spark.createDataFrame(
        [("a", f"r{i}", "2001", "f", i) for i in range(5)] + [("a", "r0", "2002", "f", 9)],
        "planet_name string, reference_name string, pub_date string, source_file string, source_row int",
    )
    vector = lambda of: F.array(F.length(of).cast("float"), F.ascii(F.right(of, F.lit(1))).cast("float"))
    more = dict(
        layout=layout, references=references,
        ask_vectors=lambda sent: sent.select("batch", "position", vector(F.col("content")).alias("embedding")),
        question_vectors=lambda changed: changed.select("name", vector(F.col("name")).alias("vector")),
    )
    for _ in range(2):  # the second time repeats the run
        go(spark, tables, 1, spark.createDataFrame([], STORED), FIRST, **more)
        sizes = {t: tables.read(spark, t).count() for t in ("solar_systems", "stars", "planets", "planet_stars", "references", "retrieval_log")}
        assert sizes == {"solar_systems": 2, "stars": 2, "planets": 3, "planet_stars": 3, "references": 5, "retrieval_log": 9}
    log = tables.read(spark, "retrieval_log")
    assert rows(log.select("planet_name").distinct()) == [("a",), ("b",), ("d",)]
    assert log.filter("retrieved_at is null or was_referenced or similarity_score is null").isEmpty()
    later = [*FIRST, (9, "e", "s2", 1.0)]
    go(spark, tables, 2, state(spark, tables, 1), later, **more)
    assert tables.of_run(spark, "planets", 2).select("planet_name").collect() == [("e",)]
    assert tables.of_run(spark, "stars", 2).isEmpty() and tables.of_run(spark, "references", 2).isEmpty()
    assert tables.of_run(spark, "retrieval_log", 2).count() == 3


def test_entity_sides_are_not_sent_through_the_driver(spark):
    many = spark.range(1000).select(F.concat(F.lit("n"), "id").alias("name"), F.lit("CONFIRMED|mFtg").alias("classification"))
    changes = many.select("name", (F.monotonically_increasing_id() % 7).alias("batch"), F.monotonically_increasing_id().alias("seq"))
    parsed = changes.select(
        "batch", F.upper("name").alias("name_key"), F.lit("X").alias("label"), F.lit("r").alias("reason"),
        F.lit(8).alias("score"), F.lit("r").alias("reasoning"),
    )
    applied = label_ops.apply_labels(changes, parsed, many, name="name")
    log = applied.changes.select("name", "field_name")
    frames = {
        "rows": applied.changes, "state": applied.entities, "graded": label_ops.labelled_entities(many, log, "name"),
        "judged": label_ops.judge_rows(many.withColumn("batch", F.lit(0)), parsed, name="name", batch="batch"),
        "texts": runs.label_texts(changes, many, name="name", line=F.col("classification")),
    }
    assert [n for n, df in frames.items() if "BroadcastExchange" in plan_of(df)] == []
    assert [frames[n].count() for n in ("rows", "state", "graded")] == [1000, 1000, 1000]
