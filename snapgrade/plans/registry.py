"""Named queries over the driver's tables, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def number_text(expr: str) -> str:
    """SQL for the log text of a double of ordinary size."""
    return f"regexp_replace(CAST({expr} AS VARCHAR), '\\.0$', '')"


def diff_sql(stored: str, incoming: str, keys: list[str], fields: dict[str, str], head: str = "") -> str:
    """SQL of the change rows; ``fields`` maps a field to 'number' or 'text'."""
    on = " AND ".join(f"o.{k} = n.{k}" for k in keys)
    key_out = ", ".join(f"coalesce(o.{k}, n.{k}) AS {k}" for k in keys)
    key_list = ", ".join(keys)
    sides = ", ".join(f"o.{f} AS old_{f}, n.{f} AS new_{f}" for f in fields)
    as_text = lambda f, side: (
        number_text(f"{side}_{f}") if fields[f] == "number" else f"CAST({side}_{f} AS VARCHAR)"
    )
    none = "NULL::VARCHAR AS field_name, NULL::VARCHAR AS old_value, NULL::VARCHAR AS new_value"
    updates = " UNION ALL ".join(
        f"SELECT {key_list}, 'UPDATE', '{f}', {as_text(f, 'old')}, {as_text(f, 'new')} FROM paired "
        f"WHERE NOT is_new AND NOT is_gone AND old_{f} IS DISTINCT FROM new_{f}"
        for f in fields
    )
    comma = ", " if head else ""
    return f"""
        WITH {head}{comma}paired AS (
          SELECT {key_out}, o.{keys[0]} IS NULL AS is_new, n.{keys[0]} IS NULL AS is_gone, {sides}
          FROM {stored} o FULL JOIN {incoming} n ON {on})
        SELECT {key_list}, 'INSERT' AS change_type, {none} FROM paired WHERE is_new
        UNION ALL SELECT {key_list}, 'DELETE', NULL, NULL, NULL FROM paired WHERE is_gone
        UNION ALL {updates}"""
