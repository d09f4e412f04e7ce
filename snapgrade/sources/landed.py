"""Landed files: JSON snapshots, JSON references, two-column CSV, stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from snapgrade import schemas
from snapgrade.functions.text import is_blank, json_field, split_first_comma, trim_all
from snapgrade.operators.dedupe import GroupedPairs, first_per_key
from snapgrade.session import materialise
from snapgrade.sources.json_arrays import json_arrays

Fields = Sequence[tuple[str, str, str]]


def _fields_of(elements: DataFrame, fields: Fields) -> DataFrame:
    """A row per element. A missing key, a null or a value of another kind reads as null."""
    values = [json_field(F.col("element"), key, kind).alias(name) for key, name, kind in fields]
    return elements.select(*values, "source_file", "source_row")


def read_snapshot(spark: SparkSession, path: str, fields: Fields = schemas.SNAPSHOT_FIELDS) -> DataFrame:
    """Flat snapshot rows with ``source_file, source_row`` as input order.

    Any file that is not one whole JSON array is refused by name: a snapshot that is partly read
    would report its other keys as deleted.
    """
    return _fields_of(_whole(json_arrays(spark, path)), fields)


def _whole(elements: DataFrame) -> DataFrame:
    # asked now: a check left in the plan would not see rows that a later filter drops first
    lost = elements.filter(F.col("source_row").isNull()).first()
    if lost is not None:
        raise ValueError(f"not a whole JSON array: {lost.source_file}")
    return elements


def unreadable_files(spark: SparkSession, path: str) -> DataFrame:
    """``source_file`` of the landed files that are no whole JSON array."""
    return json_arrays(spark, path).filter(F.col("source_row").isNull()).select("source_file")


def read_references(
    spark: SparkSession, path: str, entities: DataFrame, *, name: str = "planet_name",
    fields: Fields = schemas.REFERENCE_FIELDS, skip_unreadable: bool = True,
) -> DataFrame:
    """Reference rows of known entities.

    A file that is no whole JSON array gives no rows (``unreadable_files`` lists them), or is refused with
    ``skip_unreadable=False``. A sound file is read whole, however large it is.
    """
    elements = json_arrays(spark, path)
    elements = elements.filter(F.col("source_row").isNotNull()) if skip_unreadable else _whole(elements)
    rows = _fields_of(elements, fields)
    known = entities.select(F.col(name).alias("_known")).distinct()
    return rows.join(known, trim_all(rows["planet_name"]) == F.col("_known"), "left_semi")


def read_two_column_csv(spark: SparkSession, path: str, names: tuple[str, str] = ("planet_name", "content")) -> DataFrame:
    """Header skipped, the rest split at the first comma; blank or comma-less lines dropped.

    The CSV reader only skips each file's header here, so files stay splittable: with a rare
    separator and no quote it gives whole lines, and a line that holds the separator is kept whole as
    a record of too many columns.
    """
    lines = (
        spark.read.schema("line string, _corrupt_record string")
        .options(header=True, sep="\x01", quote="", escape="", enforceSchema=True, maxCharsPerColumn=-1)
        .csv(path)
        .select(F.coalesce("_corrupt_record", "line").alias("line"))
    )
    left, right = split_first_comma(F.col("line"))
    rows = lines.select(left.alias(names[0]), right.alias(names[1]))
    return rows.filter(~is_blank(F.col(names[0])) & ~is_blank(F.col(names[1])))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def point_lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of one key, or none; the filter reaches the scan."""
    return df.filter(F.col(key) == F.lit(value)).limit(1)


def in_list(df: DataFrame, key: str, values: Sequence[object]) -> DataFrame:
    return df.filter(F.col(key).isin(*values))


def head_rows(df: DataFrame, count: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*order).limit(count)


def changes_of_run(changes: DataFrame, run_id: int, *, run: str = "ingest_run_id", entity: str = "planet_name") -> DataFrame:
    """Change rows of one run (one partition of the log), by type and name."""
    return changes.filter(F.col(run) == run_id).orderBy("change_type", entity)


def new_references(
    rows: DataFrame, stored: DataFrame | GroupedPairs, order: Sequence[str] = ("source_file", "source_row")
) -> DataFrame:
    """Rows whose (name, reference) is neither stored nor earlier in the load.

    Stored pairs are a list, or two sides by group, in which each pair of the load is looked up. The untrimmed
    names stay available as ``raw_name, raw_reference`` for the content text.
    """
    keys = ["planet_name", "reference_name"]
    kept = rows.filter(~is_blank(F.col(keys[0])) & ~is_blank(F.col(keys[1])))
    trimmed = kept.withColumns(
        {
            "raw_name": F.col(keys[0]),
            "raw_reference": F.col(keys[1]),
            keys[0]: trim_all(F.col(keys[0])),
            keys[1]: trim_all(F.col(keys[1])),
        }
    )
    first = first_per_key(trimmed, keys, list(order))
    if isinstance(stored, GroupedPairs):
        first = materialise(first, "first-references")  # asked twice
        stored = stored.among(first)
    return first.join(stored.select(*keys).distinct(), keys, "left_anti")
