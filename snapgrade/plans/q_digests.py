"""Queries over a state with digests: the same results as the full diff, from the cells that differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from snapgrade.operators.digested_state import DigestedState
from snapgrade.plans.q_diff import CUSTOMER_DIFF_SQL
from snapgrade.plans.registry import SQL, query, table
from snapgrade.plans.standins import (
    CUSTOMER_FIELDS, LINE_FIELDS, LINE_KEYS, clean_customers, incoming_lines, stored_lines,
)
from snapgrade.session import materialise, scratch_path


def _state_of(stored: DataFrame, keys: list[str], fields: list[str], **how) -> DigestedState:
    state = DigestedState(
        scratch_path(stored.sparkSession, "digested"), stored.schema, tuple(keys), tuple(fields), **how
    )
    state.replace(stored)
    return state


def _snapshot(incoming: DataFrame, stored: DataFrame, columns: list[str]) -> DataFrame:
    """In the types of the state, written once: it is digested, then paired."""
    cast = [F.col(c).cast(stored.schema[c].dataType).alias(c) for c in columns]
    return materialise(incoming.select(*cast), "snapshot")


@query("digested_changes", CUSTOMER_DIFF_SQL)
def digested_changes(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "customer")
    state = _state_of(stored, ["c_name"], CUSTOMER_FIELDS, parts=16)
    return state.compare(_snapshot(clean_customers(spark, sf), stored, ["c_name", *CUSTOMER_FIELDS])).changes()


@query("digested_counts", SQL["diff_counts"])
def digested_counts(spark: SparkSession, sf: str) -> DataFrame:
    stored = stored_lines(spark, sf).select(*LINE_KEYS, *LINE_FIELDS)
    state = _state_of(stored, LINE_KEYS, LINE_FIELDS, parts=16)
    return state.compare(_snapshot(incoming_lines(spark, sf), stored, [*LINE_KEYS, *LINE_FIELDS])).counts()


@query("digested_state", SQL["apply_snapshot"])
def digested_state(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs over one snapshot: the first makes a version of the parts that change, the second none."""
    stored = table(spark, sf, "customer").withColumns({"created_run": F.lit(1), "updated_run": F.lit(1)})
    state = _state_of(stored, ["c_name"], CUSTOMER_FIELDS, parts=16)
    incoming = _snapshot(clean_customers(spark, sf), stored, ["c_name", *CUSTOMER_FIELDS])
    for run in (2, 3):
        state.advance(incoming, now=F.lit(run), created="created_run", updated="updated_run")
    return state.read(spark)
