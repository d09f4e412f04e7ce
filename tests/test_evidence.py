"""Evidence by committed attempts, and answers kept by content: what is there after a stage or a hook failed."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from snapgrade import schemas
from snapgrade.operators.answers import ask_missing, kept_answers
from snapgrade.sources import sinks
from test_run import FIRST, STORED, answer, counts, element, go, state, tables  # noqa: F401


def verdicts(spark, path):
    return rows(sinks.read_evidence(spark, path, schemas.DRIFT_VERDICT).select("ingest_run_id", "stage", "verdict"))


def verdict(spark, value):
    return spark.createDataFrame([(value,)], "verdict string")


def test_a_stage_killed_before_its_commit_leaves_the_former_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "verdict")
    write = lambda value, run=1, stage="drift": sinks.replace_stage(verdict(spark, value), path, schemas.DRIFT_VERDICT, run, stage)
    assert verdicts(spark, path) == []
    with monkeypatch.context() as broken:
        broken.setattr(sinks, "append_rows", lambda *_, **__: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            write("lost")
    assert verdicts(spark, path) == []  # written, but never committed
    write("one")
    write("other", 2)
    with monkeypatch.context() as broken:
        broken.setattr(sinks, "append_rows", lambda *_, **__: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            write("lost")
    assert verdicts(spark, path) == [(1, "drift", "one"), (2, "drift", "other")]
    bad = verdict(spark, "x").withColumn("verdict", F.raise_error(F.lit("in the middle")).cast("string"))
    with pytest.raises(Exception, match="in the middle"):
        sinks.replace_stage(bad, path, schemas.DRIFT_VERDICT, 1, "drift")
    assert verdicts(spark, path) == [(1, "drift", "one"), (2, "drift", "other")]


def test_a_reader_that_has_begun_ends_and_the_next_one_sees_the_new_attempt(spark, tmp_path):
    path = str(tmp_path / "verdict")
    for value in ("one", "two"):
        sinks.replace_stage(verdict(spark, value), path, schemas.DRIFT_VERDICT, 1, "drift")
    begun = sinks.read_evidence(spark, path, schemas.DRIFT_VERDICT)
    begun.count()
    sinks.replace_stage(verdict(spark, "three"), path, schemas.DRIFT_VERDICT, 1, "drift")
    assert begun.first().verdict == "two"
    assert verdicts(spark, path) == [(1, "drift", "three")]
    sinks.replace_stage(verdict(spark, "x").limit(0), path, schemas.DRIFT_VERDICT, 1, "drift")
    assert verdicts(spark, path) == []  # an attempt without rows replaces too
    numbers = sinks.committed_attempts(spark, path).first()
    assert numbers.number == 4


def test_a_run_prunes_to_its_own_partitions(spark, tmp_path):
    path = str(tmp_path / "verdict")
    for run in (1, 2, 3):
        sinks.replace_stage(verdict(spark, "v"), path, schemas.DRIFT_VERDICT, run, "drift")
    of_run = sinks.read_evidence(spark, path, schemas.DRIFT_VERDICT).where("ingest_run_id = 2")
    plan = of_run._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "verdict" in line.split("PartitionFilters")[0])
    assert "(ingest_run_id" in scan.split("PartitionFilters: [")[1].split("PushedFilters")[0] and of_run.count() == 1


class Hook:
    """Answers each text with its upper case; counts the batches it is asked; passes over those that contain ``no``."""

    def __init__(self, no=None):
        self.no, self.asked, self.calls = no, [], 0

    def __call__(self, sent):
        self.calls += 1
        self.asked += [r.batch for r in sent.collect()]
        text = F.upper("text")
        return sent.select("batch", F.when(~F.col("text").contains(self.no), text).otherwise(None).alias("text") if self.no else text.alias("text"))


def test_only_texts_without_an_answer_are_asked(spark, tmp_path):
    path = str(tmp_path / "answers")
    sent = spark.createDataFrame([(0, "aa"), (1, "bad"), (2, "aa"), (3, None), (4, "")], "batch long, text string")
    first = Hook(no="bad")
    assert rows(ask_missing(sent, path, first, model="m")) == [(0, "AA"), (2, "AA"), (4, "")]
    assert sorted(first.asked) == [0, 1, 4]  # equal texts once, by the least batch; a null text never
    second = Hook()
    assert rows(ask_missing(sent, path, second, model="m")) == [(0, "AA"), (1, "BAD"), (2, "AA"), (4, "")]
    assert second.asked == [1]
    third = Hook()
    moved = sent.withColumn("batch", F.col("batch") + 10)
    assert rows(ask_missing(moved, path, third, model="m"))[0] == (10, "AA") and third.calls == 0
    other = Hook()
    ask_missing(sent, path, other, model="other's model/7")
    assert sorted(other.asked) == [0, 1, 4]
    assert ask_missing(sent.limit(0), path, third, model="m").count() == 0 and third.calls == 0


def test_two_answers_to_one_text_are_one_on_every_read(spark, tmp_path):
    path = str(tmp_path / "answers")
    twice = spark.createDataFrame([("d", "x", None, "m"), ("d", "b", None, "m"), ("d", "a", None, "n")], schemas.ANSWERS)
    sinks.append_rows(twice, path, ["model"])
    assert rows(kept_answers(twice, path, "m")) == [("d", "b")]


def test_a_failed_run_repeated_asks_only_what_is_open(spark, tables):  # noqa: F811
    stored = spark.createDataFrame([], STORED)
    asked = []

    def counting(name, ask):
        return lambda sent: asked.append(name) or ask(sent)

    def fail(sent):
        raise RuntimeError("judge is down")

    label = answer(element('"classification": "CONFIRMED", "reasoning": "r", "plavalova_code": "mFtg"'))
    with pytest.raises(RuntimeError, match="judge is down"):
        go(spark, tables, 1, stored, FIRST, keep_answers="m", ask_judge=fail, ask_labels=counting("label", label))
    assert asked == ["label"]
    judge = counting("judge", answer(element('"score": 8')))
    for _ in range(2):
        go(spark, tables, 1, stored, FIRST, keep_answers="m", ask_judge=judge, ask_labels=counting("label", label))
    assert asked == ["label", "judge"]
    assert counts(spark, tables)["eval_result"] == 9
    assert {r.classification for r in state(spark, tables, 1).collect()} == {"CONFIRMED|mFtg"}
