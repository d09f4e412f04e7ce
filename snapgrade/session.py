"""Session settings the jobs rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Every operator that joins a many-rows side to a one-row-per-key side relies on AQE
# splitting an oversized partition of the many-rows side.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the last of a repeated key of a JSON object counts
    "spark.sql.variant.allowDuplicateKeys": "true",
    # recording the call site of every column expression doubles the time to build a plan
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "snapgrade", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; the cluster's own settings win where given in ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as named by the cluster in ``spark.checkpoint.dir``.

    Only a local session without that setting (tests on one machine) gets a local folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="snapgrade-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for one intermediate table, in the application's part of the shared folder."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to a new table in the shared folder and read it from there.

    Later readers see the very same rows, also after executors were lost, and the plan starts
    again from a table of known size.
    """
    return _written(df, label)


def materialise_packed(df: DataFrame, label: str) -> DataFrame:
    """The same for tables of long texts: packed tighter, in row groups that a task reads in little memory."""
    return _written(df, label, **{"compression": "zstd", "parquet.block.size": 32 << 20})


def _written(df: DataFrame, label: str, **options: object) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
