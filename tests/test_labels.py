import json
import random

from pyspark.sql import functions as F

from conftest import rows
from snapgrade.operators import drift, labels

ok = lambda name, label="CONFIRMED", **more: {"planet_name": name, "classification": label, "reasoning": "r", **more}

ANSWERS = {
    1: json.dumps([ok("A b", plavalova_code="eW0t"), ok("C")]),
    2: "```json\n" + json.dumps([ok("A"), ok("a", "CANDIDATE")]) + "\n```",
    3: "[{", 4: "[]", 5: json.dumps({"planet_name": "A"}),
    6: json.dumps([ok("A"), {"planet_name": "B", "classification": "X"}]),  # no reasoning
    7: json.dumps([{"planet_name": None, "classification": "X", "reasoning": "r"}, ok("B", None), ok("D", reasoning=None)]),
    8: json.dumps([ok("A"), 5]), 9: json.dumps([{**ok("A"), "planet_name": 7}]), 10: None,
    11: json.dumps([ok("A", plavalova_code=None)]), 12: "[1] trailing",
}


def answers(spark, texts=ANSWERS):
    return spark.createDataFrame(list(texts.items()), "id int, text string")


def test_parse_labels(spark):
    parsed = labels.labels_from_answers(labels.parse_answers(answers(spark), ["id"], "text", labels.LABEL_FIELDS))
    got = {(r.id, r.name_key): (r.label, r.reason) for r in parsed.collect()}
    assert got == {
        (1, "A B"): ("CONFIRMED|eW0t", "r"), (1, "C"): ("CONFIRMED", "r"), (2, "A"): ("CANDIDATE", "r"),
        (7, "D"): ("CONFIRMED", ""), (11, "A"): ("CONFIRMED", "r"),
    }


def test_skipping_only_the_broken_element(spark):
    parsed = labels.parse_answers(answers(spark), ["id"], "text", labels.LABEL_FIELDS, on_broken="skip_element")
    got = {(r.id, r.name_key) for r in parsed.collect()}
    assert {(6, "A"), (8, "A")} <= got and (6, "B") not in got and not any(i == 9 for i, _ in got)


def test_answer_status(spark):
    status = labels.answer_status(answers(spark), ["id"], "text", labels.LABEL_FIELDS)
    got = {r.id: (r.status, r.elements, r.broken) for r in status.collect()}
    assert got == {
        1: ("ok", 2, 0), 2: ("ok", 2, 0), 3: ("malformed", 0, 0), 4: ("ok", 0, 0), 5: ("malformed", 0, 0),
        6: ("broken_element", 2, 1), 7: ("ok", 3, 0), 8: ("broken_element", 2, 1), 9: ("broken_element", 1, 1),
        10: ("no_text", 0, 0), 11: ("ok", 1, 0), 12: ("malformed", 0, 0),
    }


def test_parse_judgments(spark):
    element = lambda name, score, **more: {"planet_name": name, "score": score, **more}
    texts = {
        1: json.dumps([element("A", 0, reasoning="low"), element("B", 11), element("C", 7)]),
        2: json.dumps([element("A", 7.5)]), 3: json.dumps([element("A", "7")]), 4: json.dumps([element("A", None)]),
        5: json.dumps([{"planet_name": "A"}]),
    }
    judged = labels.parse_answers(answers(spark, texts), ["id"], "text", labels.JUDGE_FIELDS)
    entities = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "planet_name string")
    got = {r.planet_name: (r.actual_value, r.score, r.pass_fail) for r in labels.judge_rows(entities, judged, name="planet_name").collect()}
    assert got == {"a": ("score=1|low", 10, "FAIL"), "b": ("score=10|", 100, "PASS"), "c": ("score=7|", 70, "PASS")}


def test_other_answer_kinds(spark):
    texts = {1: json.dumps([{"planet_name": "A", "plavalova_code": "x"}, {"planet_name": "B"}])}
    codes = labels.parse_answers(answers(spark, texts), ["id"], "text", labels.CODE_FIELDS)
    assert [(r.name_key, r.plavalova_code) for r in codes.collect()] == [("A", "x")]
    notes = labels.parse_answers(answers(spark, texts), ["id"], "text", labels.NOTE_FIELDS)
    assert rows(notes.select("name_key", "classification", "plavalova_code", "scientific_note")) == [
        ("A", "", "x", ""), ("B", "", "", ""),
    ]


def brute_force_chain(changes, answer, stored):
    current, out = dict(stored), []
    for name, batch, seq in sorted(changes, key=lambda c: (c[1], c[2])):
        label = answer.get((batch, name.upper()))
        if label is None or name not in current:
            continue
        out.append((name, batch, seq, current[name], label))
        current[name] = label
    return sorted(out, key=repr), current


def test_label_chain_against_brute_force(spark):
    rng = random.Random(3)
    names = ["p", "Q", "r", "missing"]
    # one name holds most rows, spread over enough batches to span several carry windows
    changes = [(rng.choice(["p"] * 5 + names), seq // 4, seq) for seq in range(400)]
    answer = {(b, n.upper()): rng.choice("xyz") for b in range(100) for n in names if rng.random() < 0.7}
    stored = {"p": None, "Q": "old", "r": "x"}
    frame = spark.createDataFrame(changes, "planet_name string, batch long, seq long")
    given = spark.createDataFrame([(b, n, l, "why") for (b, n), l in answer.items()], "batch long, name_key string, label string, reason string")
    entities = spark.createDataFrame(list(stored.items()), "planet_name string, classification string")
    applied = labels.apply_labels(frame, given, entities)
    want_rows, want_state = brute_force_chain(changes, answer, stored)
    assert rows(applied.changes.select("planet_name", "batch", "seq", "old_value", "new_value")) == want_rows
    assert {r.planet_name: r.classification for r in applied.entities.collect()} == want_state


def test_previous_value_over_spans(spark):
    rng = random.Random(5)
    data = [(g, o, rng.choice([None, "a", "b"])) for g in "uv" for o in rng.sample(range(500), 60)]
    df = spark.createDataFrame(data, "g string, o long, v string")
    got = {(r.g, r.o): r.before for r in labels.previous_value(df, "g", "o", "v", "before", span=16).collect()}
    for g in "uv":
        mine = sorted((o, v) for gg, o, v in data if gg == g)
        for (o, _), before in zip(mine, [None] + [v for _, v in mine]):
            assert got[(g, o)] == before


def test_grades(spark):
    entities = spark.createDataFrame(
        [("a", "CONFIRMED|EW0T"), ("b", "CANDIDATE"), ("c", "CONFIRMED|eW0"), ("d", None)], "planet_name string, classification string"
    )
    changes = spark.createDataFrame([("a", "classification"), ("a", "classification"), ("b", "classification"), ("c", "mass"), ("d", "classification")], "planet_name string, field_name string")
    chosen = labels.labelled_entities(entities, changes)
    grades = labels.grade_labels(chosen, name="planet_name", label="classification", expected_label=F.lit("CONFIRMED"), expected_code=F.lit("eW0t"))
    assert rows(grades) == [
        ("a", "CLASSIFICATION", "CONFIRMED", "CONFIRMED", 100, "accuracy", "PASS"),
        ("a", "PLAVALOVA", "eW0t", "EW0T", 100, "accuracy", "PASS"),
        ("b", "CLASSIFICATION", "CONFIRMED", "CANDIDATE", 0, "accuracy", "FAIL"),
        ("b", "PLAVALOVA", "eW0t", None, 0, "completeness", "FAIL"),
    ]
    summary = {r.eval_type: (r.passed, r.total, r.avg_score) for r in labels.grade_summary(grades).collect()}
    assert summary == {"CLASSIFICATION": (1, 2, 50.0), "PLAVALOVA": (1, 2, 50.0)}
    empty = labels.grade_summary(grades.filter("false"), groups=()).first()
    assert (empty.total, empty.avg_score) == (0, 0.0)


def evals(spark, scores):
    data = [(run, "PLAVALOVA", s) for run, values in scores.items() for s in values]
    return spark.createDataFrame(data, "ingest_run_id int, eval_type string, score int")


def ledger(spark, completed, failed=()):
    data = [(r, "COMPLETED") for r in completed] + [(r, "FAILED") for r in failed]
    return spark.createDataFrame(data, "ingest_run_id int, status string")


def verdict(spark, scores, completed, run, **how):
    row = drift.drift_check(evals(spark, scores), ledger(spark, completed, how.pop("failed", ())), run, **how).first()
    return row.verdict, row.recent_runs, row.scored_runs, row.rolling_avg


def test_drift_cases(spark):
    assert verdict(spark, {1: [None]}, [1], 1)[0] == "no_score"
    assert verdict(spark, {1: [50]}, [1], 1) == ("first_run", 0, 0, None)
    assert verdict(spark, {2: [50], 1: [None]}, [1, 2], 2) == ("no_prior_scores", 1, 0, None)
    assert verdict(spark, {1: [60], 2: [50]}, [1, 2], 2)[0] == "stable"  # a drop of exactly ten
    assert verdict(spark, {1: [61, 60, 60, 60, 60, 60, 60, 60, 60, 60], 2: [50]}, [1, 2], 2)[0] == "drift"
    # means are averaged unweighted, and a failed run does not count
    assert verdict(spark, {1: [100], 2: [0, 0, 0], 3: [0], 4: [50]}, [1, 2, 4], 4, failed=[3])[3] == 50.0


def test_drift_window_is_cut_before_unscored_runs_fall_out(spark):
    scores = {1: [10], 2: [10], 3: [90], 4: [80], 5: [70], 8: [50]}
    assert verdict(spark, scores, [1, 2, 3, 4, 5, 6, 7, 8], 8) == ("drift", 5, 3, 80.0)


def test_drift_window_also_holds_later_runs(spark):
    scores = {1: [10], 2: [20], 3: [90]}
    assert verdict(spark, scores, [1, 2, 3], 2)[3] == 50.0
    assert verdict(spark, scores, [1, 2, 3], 2, prior_only=True)[3] == 10.0


def test_variant_scores(spark):
    entities = spark.createDataFrame([("a", "eW0t"), ("b", "NG1g")], "planet_name string, want string")
    given = spark.createDataFrame([("v", "A", "eW0t"), ("v", "B", "NGxx"), ("w", "A", "ew0x")], "variant string, name_key string, code string")
    names = spark.createDataFrame([("v",), ("w",), ("none",)], "variant string")
    got = {r.variant: (r.answered, r.avg_score, r.passed) for r in drift.variant_scores(entities, given, names, name="planet_name", expected="want").collect()}
    assert got == {"v": (2, 75.0, 1), "w": (1, 37.5, 1), "none": (0, 0.0, 0)}


def test_compare_label_sets(spark):
    entities = spark.createDataFrame([("a",), ("b",), ("c",)], "planet_name string")
    left = spark.createDataFrame([("A", "x", "n1"), ("B", "y", "")], "name_key string, code string, note string")
    right = spark.createDataFrame([("A", "x", "n2")], "name_key string, code string, note string")
    got = labels.compare_label_sets(entities, left, right, name="planet_name", columns={"code": "?", "note": ""})
    assert rows(got) == [
        ("a", "x", "x", "Same", "n1", "n2", "DIFF"), ("b", "y", "?", "DIFF", "", "", "Same"), ("c", "?", "?", "Same", "", "", "Same"),
    ]


def test_the_last_of_a_repeated_key_counts(spark):
    text = '[{"planet_name": "x", "planet_name": "a", "classification": "C", "reasoning": "r"}, {"planet_name": "b", "classification": "D", "reasoning": ""}]'
    answers = spark.createDataFrame([(1, text)], "batch int, text string")
    parsed = labels.parse_answers(answers, ["batch"], "text", labels.LABEL_FIELDS)
    assert sorted((r.planet_name, r.classification) for r in parsed.collect()) == [("a", "C"), ("b", "D")]
