"""Run ledger: states are appended, the newest per run counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from snapgrade import schemas
from snapgrade.operators.dedupe import first_per_key

RUNNING, COMPLETED, FAILED = "RUNNING", "COMPLETED", "FAILED"


def _state(spark: SparkSession, **values: Column) -> DataFrame:
    columns = [
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.INGEST_RUN.fields
    ]
    return spark.range(1).select(*columns)


def open_run(
    spark: SparkSession, run_id: int, source: str, url: str | None, fetched: int | None, at: Column
) -> DataFrame:
    return _state(
        spark, id=F.lit(run_id), run_timestamp=at, source=F.lit(source), source_url=F.lit(url),
        status=F.lit(RUNNING), rows_fetched=F.lit(fetched),
    )


def complete_run(opened: DataFrame, counts: DataFrame, at: Column) -> DataFrame:
    """The closing state row: the opening row with the diff counters (both have one row)."""
    counters = counts.select(F.struct("*")).scalar()
    closed = opened.withColumn("_counters", counters).withColumns(
        {
            "status": F.lit(COMPLETED),
            "completed_at": at,
            **{c: F.col(f"_counters.{c}") for c in counts.columns},
        }
    )
    return closed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.INGEST_RUN.fields])


def fail_run(opened: DataFrame, message: str, at: Column) -> DataFrame:
    return opened.withColumns(
        {"status": F.lit(FAILED), "error_message": F.lit(message), "completed_at": at.cast("timestamp")}
    )


def latest_states(states: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """Current state per run: the last appended row."""
    return first_per_key(states, [key], order)


def latest_run_states(states: DataFrame) -> DataFrame:
    """A closed state is later than the open one, whatever the clock says."""
    return latest_states(
        states, "id", [F.when(F.col("status") == RUNNING, 1).otherwise(0), F.col("completed_at").desc_nulls_last()]
    )
