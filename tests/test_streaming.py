from pyspark.sql import types as T

from conftest import rows
from snapgrade.streaming.landing import land_snapshot, reference_job, snapshot_job

LANDED = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("k", T.StringType()), T.StructField("v", T.IntegerType())])
STATE = T.StructType(LANDED.fields[1:])


def land(spark, folder, data):
    spark.createDataFrame(data, LANDED).coalesce(1).write.mode("append").parquet(folder)


def land_whole(spark, base, snapshot, data, files=1):
    land_snapshot(spark.createDataFrame(data, LANDED).repartition(files), f"{base}/in", snapshot)


def run(spark, base):
    snapshot_job(
        spark, f"{base}/in", LANDED, state=f"{base}/state", pairs=f"{base}/pairs", changes=f"{base}/changes",
        checkpoint=f"{base}/checkpoint", state_schema=STATE, keys=["k"], fields=["v"], order=["row"],
    ).start().awaitTermination()


def test_snapshots_are_diffed_in_turn_and_once(spark, tmp_path):
    base = str(tmp_path)
    land_whole(spark, base, "one", [(1, "a", 1), (2, "b ", 2), (3, "b", 9), (4, None, 1)])
    run(spark, base)
    land_whole(spark, base, "two", [(1, "a", 5), (2, "c", 3)])
    run(spark, base)
    run(spark, base)  # nothing new landed
    changes = spark.read.parquet(f"{base}/changes")
    assert rows(changes.select("version", "k", "change_type", "old_value", "new_value")) == [
        (0, "a", "INSERT", None, None), (0, "b", "INSERT", None, None), (1, "a", "UPDATE", "1", "5"), (1, "b", "DELETE", None, None), (1, "c", "INSERT", None, None),
    ]
    assert rows(spark.read.parquet(f"{base}/state/version=1")) == [("a", 5), ("b", 2), ("c", 3)]


def test_a_snapshot_of_many_files_is_one_snapshot(spark, tmp_path):
    base = str(tmp_path)
    land_whole(spark, base, "first", [(i, f"k{i}", i) for i in range(30)], files=7)
    land_whole(spark, base, "second", [(i, f"k{i}", i) for i in range(1, 30)], files=3)
    # a snapshot that was interrupted before its manifest is not seen
    spark.createDataFrame([(1, "z", 1)], LANDED).write.parquet(f"{base}/in/data/snapshot=broken")
    run(spark, base)
    changes = spark.read.parquet(f"{base}/changes").groupBy("version", "change_type").count()
    assert rows(changes) == [(0, "INSERT", 30), (1, "DELETE", 1)]


def go(spark, base, **how):
    query = reference_job(
        spark, f"{base}/in", LANDED, table=f"{base}/table", checkpoint=f"{base}/checkpoint", keys=["k"], order=["row"], **how
    ).start()
    query.awaitTermination()
    return query


def stored(spark, base):
    return rows(spark.read.parquet(f"{base}/table").select("row", "k", "v"))


def test_references_are_stored_once(spark, tmp_path):
    base = str(tmp_path)
    land(spark, f"{base}/in", [(1, "a", 1), (2, "a ", 2), (3, "b", 3)])
    go(spark, base)
    land(spark, f"{base}/in", [(4, "a", 4), (5, "c", 5)])
    go(spark, base)
    go(spark, base)
    assert stored(spark, base) == [(1, "a", 1), (3, "b", 3), (5, "c", 5)]


def test_a_trigger_needs_its_new_rows_only(spark, tmp_path):
    base = str(tmp_path)
    land(spark, f"{base}/in", [(i, f"k{i}", i) for i in range(40)])
    go(spark, base)
    # without the stored table: what is known is the stream's state
    (tmp_path / "table").rename(tmp_path / "elsewhere")
    land(spark, f"{base}/in", [(50, "k3", 0), (51, "new", 1), (52, "k39", 2)])
    query = go(spark, base)
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [3]
    assert sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"]) == 41
    assert stored(spark, base) == [(51, "new", 1)]


def test_ties_nulls_and_repeats_of_references(spark, tmp_path):
    base = str(tmp_path)
    land(spark, f"{base}/in", [(None, "a", 1), (7, "a", 2), (None, "b", 3), (None, "b", 3), (None, None, 4), (1, "  ", 5)])
    land(spark, f"{base}/in", [(7, "a", 2), (7, "a ", 2), (None, "c", None), (None, "c", None)] + [(9, "hot", 9)] * 500)
    go(spark, base)
    assert stored(spark, base) == sorted([(7, "a", 2), (None, "b", 3), (None, "c", None), (9, "hot", 9)], key=repr)
    land(spark, f"{base}/in", [(0, "a", 0), (0, "hot", 0), (0, None, 0)])
    go(spark, base)
    assert len(stored(spark, base)) == 4


def test_a_failed_trigger_is_done_again(spark, tmp_path):
    base = str(tmp_path)
    land(spark, f"{base}/in", [(1, "a", 1)])
    go(spark, base)
    land(spark, f"{base}/in", [(2, "a", 2), (3, "b", 3)])
    go(spark, base)
    # as if the driver had died before it committed the second trigger
    for name in ("1", ".1.crc"):
        (tmp_path / "checkpoint" / "commits" / name).rename(tmp_path / f"lost{name}")
    land(spark, f"{base}/in", [(4, "b", 4), (5, "c", 5)])
    go(spark, base)
    assert stored(spark, base) == [(1, "a", 1), (3, "b", 3), (5, "c", 5)]


def test_one_file_at_a_time_gives_the_same(spark, tmp_path):
    base = str(tmp_path)
    for part in range(3):
        land(spark, f"{base}/in", [(part * 10 + i, f"k{i + part}", part) for i in range(4)])
    go(spark, base, files_per_trigger=1)
    kept = [(k, v) for _, k, v in stored(spark, base)]
    assert sorted(k for k, _ in kept) == [f"k{i}" for i in range(6)]
