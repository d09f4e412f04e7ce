"""Queries of this subpackage, apart from those of the rest of the library."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


ROOT = str(Path(__file__).resolve().parents[2])


def share_library(spark: SparkSession) -> None:
    """Have Python workers on this machine import the library from where the driver has it.

    On a cluster the library is installed on executors, or given with ``--py-files``.
    """
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{paths}".rstrip(":")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @wraps(run)
        def shared(spark: SparkSession, sf: str) -> DataFrame:
            share_library(spark)
            return run(spark, sf)

        QUERIES[name] = shared
        if sql is not None:
            SQL[name] = sql
        return shared

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")
