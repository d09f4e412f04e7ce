"""Table writes: append-only evidence tables and replaceable state tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from snapgrade import schemas


def append_rows(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append rows. A partitioned append of no rows adds no file."""
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or no rows if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def committed_attempts(spark: SparkSession, path: str) -> DataFrame:
    """The valid attempt of each stage of each run: ingest_run_id, stage, attempt, number."""
    newest = F.max(F.struct("number", "attempt")).alias("newest")
    found = read_or_empty(spark, f"{path}_commits", schemas.STAGE_COMMITS).groupBy("ingest_run_id", "stage").agg(newest)
    return found.select("ingest_run_id", "stage", "newest.attempt", "newest.number")


def replace_stage(df: DataFrame, path: str, schema: T.StructType, run_id: int, stage: str) -> None:
    """Write what a stage of a run leaves as evidence; the same stage run again replaces it.

    Columns are those of the table's schema, in its types; those ``df`` lacks are null. Each attempt has
    a folder of its own, and counts once the table of commits beside names it: until then, also if the
    stage is killed at any point, readers see what an earlier attempt left. A stage has one writer at a
    time. Files of replaced attempts stay, so that a reader who has begun can end.
    """
    have = set(df.columns)
    own = [f for f in schemas.evidence_schema(schema).fields if f.name not in ("ingest_run_id", "stage")]
    columns = [(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in own]
    spark, attempt = df.sparkSession, uuid.uuid4().hex
    df.select(*columns).write.parquet(f"{path}/ingest_run_id={run_id}/stage={stage}/attempt={attempt}")
    mine = (F.col("ingest_run_id") == run_id) & (F.col("stage") == stage)
    last = committed_attempts(spark, path).where(mine).first()
    commit = [(run_id, stage, attempt, last.number + 1 if last else 1)]
    append_rows(spark.createDataFrame(commit, schemas.STAGE_COMMITS).coalesce(1), f"{path}_commits")


def read_evidence(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Committed rows of all runs of an evidence table, with ``ingest_run_id`` and ``stage``; none before the first commit."""
    whole = T.StructType([*schemas.evidence_schema(schema).fields, T.StructField("attempt", T.StringType())])
    valid = committed_attempts(spark, path).drop("number")
    return read_or_empty(spark, path, whole).join(valid, ["ingest_run_id", "stage", "attempt"], "left_semi").drop("attempt")


def append_tables(frames: Mapping[str, DataFrame], base: str) -> None:
    """Append each frame to the table of its name below ``base``, in the given order."""
    for name, df in frames.items():
        append_rows(df, f"{base}/{name}")


def write_state(df: DataFrame, path: str) -> None:
    """A new version of a state table at a path of its own, never over the one being read."""
    df.write.mode("errorifexists").parquet(path)


def save_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int) -> None:
    """A state table bucketed and sorted on the natural key: the next diff then shuffles only
    the incoming side."""
    first, *rest = keys
    df.write.mode("overwrite").bucketBy(buckets, first, *rest).sortBy(first, *rest).saveAsTable(table)
