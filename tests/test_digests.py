import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from conftest import plan_of, rows
from snapgrade.operators import diff
from snapgrade.operators.digested_state import DigestedState

SCHEMA = T.StructType(
    [
        T.StructField("k", T.StringType()),
        T.StructField("a", T.IntegerType()),
        T.StructField("b", T.StringType()),
        T.StructField("c", T.DoubleType()),
        T.StructField("note", T.StringType()),
    ]
)
FIELDS = ["a", "b", "c"]


def state_at(tmp_path, **how):
    return DigestedState(str(tmp_path), SCHEMA, ("k",), tuple(FIELDS), **{"parts": 4, "cells": 8, **how})


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def same(spark, state, stored, incoming):
    found = state.compare(incoming)
    assert rows(found.changes()) == rows(diff.snapshot_diff(stored, incoming, ["k"], FIELDS))
    assert tuple(found.counts().first()) == tuple(diff.diff_counts(stored, incoming, ["k"], FIELDS).first())
    return found


def test_changes_counts_and_next_states(spark, tmp_path):
    state = state_at(tmp_path)
    stored = frame(spark, [(f"k{i}", i, "x", i / 2, "n") for i in range(60)] + [("nulls", None, None, None, None)])
    state.replace(stored)
    assert rows(state.read(spark)) == rows(stored)
    incoming = frame(spark, [(f"k{i}", i, "x", i / 2, None) for i in range(5, 60)] + [("new", 1, None, 0.0, "z"), ("nulls", None, "", None, None)])
    same(spark, state, stored, incoming)
    for mode in ("keep", "drop"):
        path = tmp_path / mode
        mine = state_at(path)
        mine.replace(stored)
        mine.advance(incoming, delete_mode=mode)
        assert rows(mine.read(spark)) == rows(diff.apply_snapshot(stored, incoming, ["k"], FIELDS, delete_mode=mode))
        assert mine.version(spark) == 1
        # the digests are those of the rows
        again = state_at(path / "again")
        again.replace(mine.read(spark))
        assert rows(again.digests(spark)) == rows(mine.digests(spark))


def test_nothing_new_makes_no_version(spark, tmp_path):
    state = state_at(tmp_path)
    stored = frame(spark, [(f"k{i}", i, "x", 0.0, "n") for i in range(20)])
    state.replace(stored)
    found = state.advance(stored.withColumn("c", -F.col("c")))
    assert state.version(spark) == 0 and found.parts == [] and tuple(found.counts().first()) == (0, 0, 0, 20)
    # a kept key that is gone is a delete each time, and no reason for a version
    for _ in range(2):
        found = state.advance(stored.filter("k <> 'k3'"))
        assert rows(found.changes()) == [("k3", "DELETE", None, None, None)] and state.version(spark) == 0
        assert tuple(found.counts().first()) == (0, 0, 1, 19)


def test_nulls_do_not_change_places_unseen(spark, tmp_path):
    state = state_at(tmp_path, parts=1, cells=1)
    stored = frame(spark, [("k", None, "1", None, None), ("l", 1, None, None, None)])
    state.replace(stored)
    same(spark, state, stored, frame(spark, [("k", 1, None, None, None), ("l", None, "1", None, None)]))


def test_empty_sides_and_columns_of_any_name(spark, tmp_path):
    state = state_at(tmp_path)
    nothing, one = frame(spark, []), frame(spark, [("k", 1, "x", 1.0, "n")])
    assert state.version(spark) is None and rows(state.read(spark)) == []
    same(spark, state, nothing, one.withColumns({"_part": F.lit("p"), "o.rows": F.lit(1)}))
    state.advance(one)
    assert rows(state.read(spark)) == [("k", 1, "x", 1.0, None)]  # carried columns are not the snapshot's
    same(spark, state, one, nothing)
    state.advance(nothing, delete_mode="drop")
    assert rows(state.read(spark)) == [] and rows(state.digests(spark)) == []
    same(spark, state, nothing, nothing)


def test_a_version_without_its_commit_is_not_seen(spark, tmp_path, monkeypatch):
    state = state_at(tmp_path)
    stored = frame(spark, [(f"k{i}", i, "x", 0.0, "n") for i in range(20)])
    state.replace(stored)
    incoming = stored.withColumn("a", F.col("a") + 1)
    # as if the driver had died when data, digests and places of version 1 were there, of other rows
    other = state_at(tmp_path / "other")
    other.replace(stored)
    other.advance(stored.withColumn("b", F.lit("lost")))
    for name in ("data/version=1", "digests/version=1", "places/of=1"):
        (tmp_path / "other" / name).rename(tmp_path / name)
    assert rows(state.read(spark)) == rows(stored)
    state.advance(incoming)
    assert rows(state.read(spark)) == rows(incoming)


def test_little_change_reads_and_pairs_little(spark, tmp_path):
    state = state_at(tmp_path, parts=16, cells=1024)
    stored = spark.range(40000).select(
        F.concat(F.lit("k"), "id").alias("k"), F.col("id").cast("int").alias("a"), F.lit("x").alias("b"),
        F.lit(0.5).alias("c"), F.lit(None).cast("string").alias("note"),
    )
    state.replace(stored)
    incoming = stored.withColumn("a", F.when(F.col("a") % 100 == 7, -1).otherwise(F.col("a")))
    found = state.compare(incoming)
    assert tuple(found.counts().first()) == (0, 400, 0, 39600)
    cells, pairs = found.cells.count(), found.paired.count()
    assert 380 <= cells <= 400 and pairs < 1600  # 1 % of the rows, about 2.4 rows a cell
    # a change in one key: one part is read and written
    moved = stored.withColumn("a", F.when(F.col("k") == "k5", 0).otherwise(F.col("a")))
    found = state.advance(moved)
    assert len(found.parts) == 1
    plan = plan_of(state.read(spark, found.parts))
    assert "PartitionFilters: [" in plan and "_part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {p.name for p in (tmp_path / "data/version=1").iterdir() if p.is_dir()} == {f"_part={found.parts[0]}"}
    assert rows(state.read(spark).exceptAll(moved)) == [] and state.read(spark).count() == 40000


def test_wrong_settings(spark, tmp_path):
    state = state_at(tmp_path)
    state.replace(frame(spark, [("k", 1, "x", 1.0, "n")]))
    with pytest.raises(ValueError, match="other settings"):
        state_at(tmp_path, cells=9).read(spark)
    with pytest.raises(ValueError, match="cast it first"):
        state.compare(frame(spark, []).withColumn("a", F.lit(1.5)))
    with pytest.raises(ValueError, match="missing"):
        DigestedState(str(tmp_path), SCHEMA, ("k",), ("zz",))


VALUES = st.dictionaries(
    st.sampled_from("abcdefgh"), st.tuples(st.sampled_from([None, 1, 2]), st.sampled_from([None, "", "x"]), st.sampled_from([None, 0.0, -0.0, 1.5])), max_size=8
)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=VALUES, b=VALUES)
def test_as_the_full_diff(spark, tmp_path_factory, a, b):
    stored, incoming = (frame(spark, [(k, *v, None) for k, v in side.items()]) for side in (a, b))
    state = state_at(tmp_path_factory.mktemp("state"), parts=2, cells=2)
    state.replace(stored)
    same(spark, state, stored, incoming)
    state.advance(incoming)
    assert rows(state.read(spark)) == rows(diff.apply_snapshot(stored, incoming, ["k"], FIELDS))
