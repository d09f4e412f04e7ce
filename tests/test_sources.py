import json
import sys

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows
from snapgrade import schemas
from snapgrade.functions.text import CONTENT_MEASURES
from snapgrade.operators import ledger
from snapgrade.operators.dedupe import GroupedPairs, clean_keys, first_per_key
from snapgrade.plans import run as runs
from snapgrade.sources import landed, sinks
from snapgrade.sources.json_arrays import json_arrays


def test_snapshot_tolerates_missing_null_and_wrong_kinds(spark, tmp_path):
    elements = [
        {"pl_name": "a", "hostname": "s", "disc_year": 2000, "pl_bmasse": 1.5, "sy_snum": 2, "more": {"x": 1}},
        {"pl_name": "b\t", "hostname": None, "disc_year": "2001", "pl_bmasse": "heavy", "pl_rade": 2},
        {"pl_name": "b", "hostname": "s", "pl_bmasse": 9.0},
        {"hostname": " "},
    ]
    (tmp_path / "one.json").write_text(json.dumps(elements, indent=1))
    got = landed.read_snapshot(spark, str(tmp_path))
    assert got.columns[:19] == [name for _, name, _ in schemas.SNAPSHOT_FIELDS]
    shown = got.orderBy("source_file", "source_row").select("planet_name", "host_star", "discovery_year", "planet_mass", "planet_radius", "num_stars")
    assert [tuple(r) for r in shown.collect()] == [
        ("a", "s", 2000, 1.5, None, 2), ("b\t", None, None, None, 2.0, None), ("b", "s", None, 9.0, None, None), (None, " ", None, None, None, None),
    ]
    first = first_per_key(clean_keys(got, ["planet_name"]), ["planet_name"], ["source_file", "source_row"])
    assert rows(first.select("planet_name", "planet_mass")) == [("a", 1.5), ("b", None)]


def read_names(spark, folder):
    return sorted(r.planet_name for r in landed.read_snapshot(spark, str(folder)).select("planet_name").collect())


def test_whole_arrays_are_read_whatever_they_hold(spark, tmp_path):
    wide = '[{"pl_name": "' + "x" * 4081 + 'é"}]'  # a two-byte character across byte 4096
    assert len(wide[:-4].encode()) == 4095
    (tmp_path / "a.json").write_text(wide)
    (tmp_path / "b.json").write_text(" \n" * 2500 + '[{"pl_name": "late"}]')
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text('[{"pl_name": "first", "pl_name": "last"}]')
    assert read_names(spark, tmp_path) == ["last", "late", "x" * 4081 + "é"]


@pytest.mark.parametrize("text", ['{"pl_name": "a"}', '[{"pl_name": "a"}, {"pl_name": "b', '[{"pl_name": "a"}] [', "[] []", "[], []", "not json"])
def test_a_damaged_snapshot_stops_the_job(spark, tmp_path, text):
    (tmp_path / "good.json").write_text('[{"pl_name": "a"}]')
    (tmp_path / "broken.json").write_text(text)
    with pytest.raises(Exception, match="not a whole JSON array: .*broken.json"):
        read_names(spark, tmp_path)
    assert [r.source_file.rsplit("/")[-1] for r in landed.unreadable_files(spark, str(tmp_path)).collect()] == ["broken.json"]


ODD = [
    {"pl_name": 'quote " and } and ]', "pl_refname": "back\\\\slash\\\\"}, 7, "alone }{", [1, {"pl_name": "inner"}], None,
    {"pl_name": "nested", "more": {"a": [{"b": "}"}, {}], "c": {}}}, {"pl_name": "é}日本{"}, {}, {"pl_name": ""}, [], [[{"x": 1}]], True,
]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("split", ["16", "64", "1m"])
def test_arrays_cut_at_any_byte(spark, tmp_path, indent, split):
    elements = ODD * 3
    (tmp_path / "a.json").write_text(json.dumps(elements, indent=indent, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps([1, "x"], indent=indent))
    (tmp_path / "c.json").write_text(json.dumps([e for e in ODD if e], indent=indent)[:-1])  # no end
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = json_arrays(spark, str(tmp_path)).select("source_file", "source_row", F.to_json("element").alias("e")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {f: sorted((r.source_row, r.e) for r in found if r.source_file.endswith(f) and r.source_row is not None) for f in ("a.json", "b.json", "c.json")}
    assert [n for n, _ in got["a.json"]] == list(range(len(elements)))
    assert [json.loads(e) if e else None for _, e in got["a.json"]] == elements
    assert [e for _, e in got["b.json"]] == ["1", '"x"'] and got["c.json"] == []
    assert [r.source_file.rsplit("/")[-1] for r in found if r.source_row is None] == ["c.json"]


def test_an_array_larger_than_one_value_may_be(spark, tmp_path):
    """150 MB in one line: read by several tasks, and no reference of it is lost."""
    one = json.dumps({"pl_name": "a", "pl_refname": "r", "pl_pubdate": "x" * 1000})
    with open(tmp_path / "large.json", "w") as out:
        out.write("[" + one)
        for _ in range(150_000 - 1):
            out.write("," + one)
        out.write("]")
    (tmp_path / "small.json").write_text(json.dumps([{"pl_name": "a", "pl_refname": "s"}, {"pl_name": "b", "pl_refname": "s"}]))
    entities = spark.createDataFrame([("a",)], "planet_name string")
    found = landed.read_references(spark, str(tmp_path), entities).groupBy("reference_name").agg(
        F.count(F.lit(1)).alias("rows"), F.max("source_row").alias("last")
    )
    assert rows(found) == [("r", 150_000, 149_999), ("s", 1, 0)]


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_chunks_may_be_cut_behind_any_brace(spark, tmp_path, monkeypatch, size):
    """Elements across chunks, escapes at their borders, files that end early: rows and places are the same."""
    monkeypatch.setattr(sys.modules[json_arrays.__module__], "CHUNK_BYTES", size)
    elements = ODD * 2 + [{"t": '\\"}\\', "u": ["}", {"v": '"'}]}, "\\", {"deep": [[{"x": [{}]}]]}, 3, 4]
    (tmp_path / "a.json").write_text(json.dumps(elements))
    (tmp_path / "b.json").write_text("[" + ", ".join(json.dumps({"n": i}) for i in range(30)) + " ]\n")
    for i, text in enumerate(['[{"a": 1}', '[{"a": 1}}', '[{"a": {}}', '[{"a": "\\}"}]', "[] []", '[{"a": 1}, ]', '[{"a": "}]']):
        (tmp_path / f"lost{i}.json").write_text(text)
    found = json_arrays(spark, str(tmp_path)).select("source_file", "source_row", F.to_json("element").alias("e")).collect()
    got = {f: sorted((r.source_row, r.e) for r in found if r.source_file.endswith(f) and r.source_row is not None) for f in ("a.json", "b.json")}
    assert [n for n, _ in got["a.json"]] == list(range(len(elements)))
    assert [json.loads(e) if e else None for _, e in got["a.json"]] == elements
    assert got["b.json"] == [(i, f'{{"n":{i}}}') for i in range(30)]
    lost = [r for r in found if "lost" in r.source_file]
    assert len(lost) == 7 and all(r.source_row is None for r in lost)


def test_elements_within_a_chunk_are_not_shuffled(spark, tmp_path, monkeypatch):
    """What is written on the way: texts once, packed, and parsed elements; no text or element is exchanged."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps([{"pl_name": f"n{i}", "t": "text of some length"} for i in range(20_000)]))
    plans, module = {}, sys.modules[json_arrays.__module__]
    kept = module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, label: plans.update({label: plan_of(df)}) or kept(df, label))
    found = json_arrays(spark, str(folder))
    assert found.count() == 20_000 and "Exchange" not in plans["chunks"]
    # exchanges hold the chunks' levels and sums, never their texts
    exchanged = "\n".join(plan_part for plan_part in plans["elements"].split("Exchange hashpartitioning")[1:])
    assert "text#" not in exchanged.split("FileScan")[0]
    assert rows(found.groupBy().agg(F.min("source_row"), F.max("source_row"), F.count_distinct("source_row"))) == [(0, 19_999, 20_000)]


def test_references_of_damaged_files_can_stop_the_job(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"pl_name": "a", "pl_refname": "r"}')
    entities = spark.createDataFrame([("a",)], "planet_name string")
    assert landed.read_references(spark, str(tmp_path), entities).isEmpty()
    with pytest.raises(Exception, match="not a whole JSON array: .*r.json"):
        landed.read_references(spark, str(tmp_path), entities, skip_unreadable=False)


def test_references(spark, tmp_path):
    ref = lambda name, title, **more: {"pl_name": name, "pl_refname": title, **more}
    elements = [ref(" a", "R1", pl_bmasse=1.0, pl_pubdate="2001"), ref("a", "R1 ", pl_bmasse=2.0), ref("a", "R2"), ref("b", "R1"), ref("z", "R1"), ref("a", " "), ref("a", None)]
    (tmp_path / "r.json").write_text(json.dumps(elements))
    (tmp_path / "s.json").write_text("not json")
    entities = spark.createDataFrame([("a",), ("b",)], "planet_name string")
    found = landed.read_references(spark, str(tmp_path), entities)
    stored = spark.createDataFrame([("b", "R1")], "planet_name string, reference_name string")
    loaded = runs.load_references(found, stored, measures=CONTENT_MEASURES, method="discovery_method", size=1)
    got = sorted((r.planet_name, r.reference_name, r.pub_date, r.content, r.batch) for r in loaded.collect())
    assert got == [("a", "R1", "2001", " a, R1, mass=1.00 Earth masses", 0), ("a", "R2", "", "a, R2", 1)]


def test_stored_references_by_group_are_looked_up(spark):
    """300 names of a group with 300 references: 90,000 stored pairs, of which none but those of the load are made."""
    loads = [(f" n{i % 400}", f"r{i % 350}\t", "2001", i) for i in range(2000)] + [("n401", "r1", "2002", 0), ("n402", "r402", "2003", 0)]
    found = spark.createDataFrame(loads, "planet_name string, reference_name string, pub_date string, at int")
    names = spark.createDataFrame(
        [(f"n{i}", 1) for i in range(300)] * 2 + [("n7", 2), ("n401", None)], "planet_name string, number int"
    )
    titles = spark.createDataFrame(
        [(f"r{i}", 1) for i in range(300)] + [("r320", 2), ("r1", None), ("r402", 2)], "reference_name string, number int"
    )
    listed = names.join(titles, "number").select("planet_name", "reference_name")
    pairs = GroupedPairs(names, titles, "number")
    asked = found.selectExpr("trim(planet_name) AS planet_name", "trim(BOTH '\t' FROM reference_name) AS reference_name").distinct()
    assert rows(pairs.among(asked).distinct()) == rows(asked.join(listed.distinct(), ["planet_name", "reference_name"], "left_semi"))
    load = lambda stored: runs.load_references(found, stored, order=("at",), size=7)
    assert rows(load(pairs)) == rows(load(listed))
    # no list is shuffled that is longer than the load
    kept = materialised_rows(pairs.among(asked))
    assert kept and max(kept) <= asked.count() * 2


def materialised_rows(df):
    """Rows that the joins of a plan give, after it has run."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "Join" in node.nodeName():
            found.append(node.metrics().apply("numOutputRows").value())
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_two_column_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('planet_name,content\n"HD 1","one, two ""x"""\nno comma\n  ,blank name\nname,""\n\nb , plain \n')
    (tmp_path / "b.csv").write_text('planet_name,content\nc,"d"\n')
    assert rows(landed.read_two_column_csv(spark, str(tmp_path))) == [("HD 1", 'one, two ""x'), ("b", "plain"), ("c", "d")]


def test_csv_keeps_lines_that_hold_the_separator(spark, tmp_path):
    (tmp_path / "a.csv").write_text("planet_name,content\nk1,abc\x01def\nk2,a\x01b\x01c\nk3,plain\n")
    assert rows(landed.read_two_column_csv(spark, str(tmp_path))) == [("k1", "abc\x01def"), ("k2", "a\x01b\x01c"), ("k3", "plain")]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "run int, v string")
    sinks.append_rows(df, path, ["run"])
    sinks.append_rows(df.filter("false"), path, ["run"])
    sinks.append_rows(df.filter("run = 2"), path, ["run"])
    assert rows(spark.read.parquet(path).select("run", "v")) == [(1, "a"), (2, "b"), (2, "b")]
    state = str(tmp_path / "s")
    sinks.write_state(df, state)
    with pytest.raises(Exception):
        sinks.write_state(df, state)


def test_bucketed_state_is_not_shuffled_by_the_diff(spark):
    from conftest import plan_of
    from snapgrade.operators.diff import pair_snapshots

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = spark.range(100).selectExpr("cast(id as string) as k", "id as v")
        sinks.save_bucketed(stored, "bucketed_state", ["k"], 4)
        incoming = spark.range(50, 150).selectExpr("cast(id as string) as k", "id as v")
        plan = plan_of(pair_snapshots(spark.table("bucketed_state"), incoming, ["k"], ["v"]))
        assert plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table if exists bucketed_state")


def test_scans(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    assert rows(landed.point_lookup(df, "k", "b")) == [("b", 2)]
    assert rows(landed.point_lookup(df, "k", "x")) == []
    assert rows(landed.in_list(df, "k", ["a", "c", "x"])) == [("a", 1), ("c", 3)]
    assert [r.k for r in landed.head_rows(df, 2, ["v"]).collect()] == ["a", "b"]


def test_run_keeps_a_ledger_and_fails_visibly(spark, tmp_path):
    tables = runs.RunTables(str(tmp_path / "run"))
    stored = spark.createDataFrame([("a", 1)], "k string, v int")
    incoming = spark.createDataFrame([(1, "a", 2), (2, "b ", 1), (3, None, 1)], "row int, k string, v int")
    at = F.lit("2024-01-01").cast("timestamp")
    how = dict(keys=["k"], fields=["v"], order=["row"], at=at)
    result = runs.ingest(spark, tables, 1, stored, incoming, **how).first()
    assert result.asDict() == {"fetched": 3, "valid_incoming": 2, "existing": 1, "inserted": 1, "updated": 1, "skipped": 1}
    with pytest.raises(Exception):
        runs.ingest(spark, tables, 2, stored, incoming.withColumn("v", F.raise_error(F.lit("boom")).cast("int")), **how)
    states = tables.read(spark, "ingest_run")
    latest = {r.id: (r.status, r.rows_new) for r in ledger.latest_run_states(states).collect()}
    assert latest == {1: ("COMPLETED", 1), 2: ("FAILED", None)}
    only_a = runs.ingest(spark, tables, 3, stored, incoming, entity_filter=F.lower("k") == "a", **how).first()
    assert only_a.fetched == 1


def test_places_of_json_pieces_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Their files are small for very many rows, so their size on disk must not decide."""
    (tmp_path / "a.json").write_text(json.dumps([{"n": i} for i in range(50)]))
    plans, module = {}, sys.modules[json_arrays.__module__]
    kept = module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, label: plans.update({label: plan_of(df)}) or kept(df, label))
    rows_read = json_arrays(spark, str(tmp_path))
    assert "SortMergeJoin" in plans["elements"] and "SortMergeJoin" in plan_of(rows_read)
    assert [r.source_row for r in rows_read.orderBy("source_row").collect()] == list(range(50))
