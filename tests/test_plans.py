"""Plans: pruning and pushdown reach the scans, entity data never goes through one task."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF, plan_of
from snapgrade.operators import drift
from snapgrade.plans.catalogue import QUERIES
from snapgrade.sources import landed, sinks

# one-row totals, and the window over one row per range partition
BOUNDED_SINGLE = {
    "diff_counts", "digested_counts", "run_result", "diff_scaled", "null_check", "length_check", "width_check", "snapshot_run",
    "drift_check", "drift_check_prior_only", "assign_batches", "batch_text", "judge_text", "change_batch_text",
    "variant_texts", "run_filter_sort", "load_references", "variant_scores", "bulk_append", "topk_lsh_recall",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_single_task_over_entities(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    if name not in BOUNDED_SINGLE:
        assert "SinglePartition" not in plan


def scan_of(spark, name):
    return plan_of(QUERIES[name](spark, SF))


def test_filters_reach_the_scan(spark):
    assert "EqualTo(c_name,Customer#000000007)" in scan_of(spark, "point_lookup")
    assert re.search(r"PushedFilters: \[.*In\(p_brand", scan_of(spark, "in_list"))
    assert "GreaterThanOrEqual(l_extendedprice,2000.0)" in scan_of(spark, "diff_counts")


def test_only_needed_columns_are_read(spark):
    assert "ReadSchema: struct<o_custkey:bigint>" in scan_of(spark, "key_set")
    assert "ReadSchema: struct<user_id:bigint" not in scan_of(spark, "run_averages")
    assert "ReadSchema: struct<l_quantity:double>" in scan_of(spark, "clamp_scale")
    assert "text" not in re.search(r"ReadSchema: struct<doc_id[^>]*>", scan_of(spark, "composite_split_join")).group()


@pytest.mark.parametrize("name", ["first_per_key", "topk_global", "topk_same_entity", "report_text", "ledger_latest"])
def test_rank_limits_run_before_the_exchange(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    limit = plan.rindex("WindowGroupLimit")
    assert "Exchange hashpartitioning" in plan[:limit], "the innermost limit stands below an exchange"


def test_evidence_tables_are_read_by_run(spark, tmp_path):
    evals = spark.range(60).select(
        (F.col("id") % 12).cast("int").alias("ingest_run_id"), F.lit("PLAVALOVA").alias("eval_type"), F.lit(50).alias("score")
    )
    path = str(tmp_path / "eval")
    sinks.append_rows(evals, path, ["ingest_run_id"])
    runs = spark.range(12).select(F.col("id").cast("int").alias("ingest_run_id"), F.lit("COMPLETED").alias("status"))
    check = drift.drift_check(spark.read.parquet(path), runs, 3)
    assert re.search(r"PartitionFilters: \[.*ingest_run_id#\d+ IN \(3,11,10,9,8,7\)", plan_of(check))
    assert check.first().verdict == "stable"
    log = spark.read.parquet(path).select("ingest_run_id", F.col("eval_type").alias("change_type"), F.col("score").alias("planet_name"))
    assert re.search(r"PartitionFilters: \[.*ingest_run_id#\d+ = 5", plan_of(landed.changes_of_run(log, 5)))
