"""Snapshot comparison: pair once, then read changes, counts and the next state off the pairs.

``pair_snapshots`` is the only shuffle: one full outer join on the natural key, both sides
projected to the compared columns. Where the incoming side was de-duplicated on the same key
the join uses that exchange again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from snapgrade.functions.text import value_to_text

INSERT, UPDATE, DELETE, UNCHANGED = "INSERT", "UPDATE", "DELETE", "UNCHANGED"

CHANGE_COLUMNS = ("change_type", "field_name", "old_value", "new_value")


def _fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType))


def _differs(
    before: Column,
    after: Column,
    before_type: T.DataType,
    after_type: T.DataType,
    compare: str,
    scale: tuple[int, int] | None,
) -> Column:
    if scale is not None and _fractional(before_type) and _fractional(after_type):
        stored_type = T.DecimalType(*scale)
        before, after = before.try_cast(stored_type), after.try_cast(stored_type)
    elif before_type != after_type and compare == "text":
        before, after = value_to_text(before, before_type), value_to_text(after, after_type)
    elif before_type != after_type:
        after = after.try_cast(before_type)
    return ~before.eqNullSafe(after)


def pair_snapshots(
    stored: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str],
    *,
    compare: str = "text",
    scale: tuple[int, int] | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per key of either side with ``old``/``new`` structs, changed flags and a status.

    ``compare="text"`` compares the log texts, ``"typed"`` the values (sides of different type
    are then cast to the stored type). Equal values of one type have equal texts and the other
    way round, so texts are only built where the two types differ. ``scale=(p, s)`` compares
    fractional numbers after rounding both sides to the stored decimal. ``carry`` names stored
    columns that are not compared but belong to the next state.
    """
    if compare not in ("text", "typed"):
        raise ValueError("compare must be 'text' or 'typed'")
    old = stored.select(*keys, F.struct(*fields).alias("old"), *([F.struct(*carry).alias("carried")] if carry else []))
    new = incoming.select(*keys, F.struct(*fields).alias("new"))
    flags = {
        f: _differs(
            F.col(f"old.{f}"), F.col(f"new.{f}"),
            stored.schema[f].dataType, incoming.schema[f].dataType, compare, scale,
        )
        for f in fields
    }
    status = (
        F.when(F.col("old").isNull(), INSERT)
        .when(F.col("new").isNull(), DELETE)
        .when(reduce(lambda a, b: a | b, flags.values()), UPDATE)
        .otherwise(UNCHANGED)
    )
    return old.join(new, list(keys), "full_outer").withColumns(
        {"status": status, "changed": F.struct(*[flag.alias(f) for f, flag in flags.items()])}
    )


def changes_of(paired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per inserted or deleted key, one row per changed field of an updated key.

    Unchanged keys are filtered before anything is generated; a single ``explode`` gives all
    three kinds, so the join below runs once.
    """
    fields = paired.schema["changed"].dataType.names
    old_types = paired.schema["old"].dataType
    new_types = paired.schema["new"].dataType
    nothing = F.lit(None).cast("string")
    entry = lambda name, old, new: F.struct(
        name.alias("field_name"), old.alias("old_value"), new.alias("new_value")
    )
    updates = F.array(
        *[
            F.when(
                F.col(f"changed.{f}"),
                entry(
                    F.lit(f),
                    value_to_text(F.col(f"old.{f}"), old_types[f].dataType),
                    value_to_text(F.col(f"new.{f}"), new_types[f].dataType),
                ),
            )
            for f in fields
        ]
    )
    whole_row = F.array(entry(nothing, nothing, nothing))
    rows = F.when(F.col("status") == UPDATE, updates).otherwise(whole_row)
    return (
        paired.filter(F.col("status") != UNCHANGED)
        .select(*keys, F.col("status").alias("change_type"), F.explode(rows).alias("change"))
        .filter(F.col("change").isNotNull())
        .select(*keys, "change_type", "change.*")
    )


def counts_of(paired: DataFrame) -> DataFrame:
    """One row: new, updated, deleted and unchanged keys."""
    count = lambda status: F.count_if(F.col("status") == status)
    return paired.agg(
        count(INSERT).alias("rows_new"),
        count(UPDATE).alias("rows_updated"),
        count(DELETE).alias("rows_deleted"),
        count(UNCHANGED).alias("rows_unchanged"),
    )


def snapshot_diff(
    stored: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str],
    *,
    compare: str = "text",
    scale: tuple[int, int] | None = None,
    reported_deletes: DataFrame | None = None,
) -> DataFrame:
    """Change rows between two snapshots with unique keys.

    A deleted key is reported on every run; give the keys reported before in
    ``reported_deletes`` to have each reported once.
    """
    changes = changes_of(pair_snapshots(stored, incoming, keys, fields, compare=compare, scale=scale), keys)
    if reported_deletes is None:
        return changes
    known = reported_deletes.select(*keys, F.lit(DELETE).alias("change_type")).distinct()
    return changes.join(known, [*keys, "change_type"], "left_anti")


def diff_counts(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], fields: Sequence[str], **how) -> DataFrame:
    return counts_of(pair_snapshots(stored, incoming, keys, fields, **how))


def state_of(
    paired: DataFrame,
    stored_schema: T.StructType,
    keys: Sequence[str],
    fields: Sequence[str],
    *,
    now: Column | None = None,
    created: str | None = None,
    updated: str | None = None,
    delete_mode: str = "keep",
) -> DataFrame:
    """The next stored state from pairs that carry all other stored columns.

    New keys are added, present keys take all incoming fields (and a new ``updated`` time if
    one differs), all other stored columns stay. ``delete_mode="keep"`` leaves keys that are
    not incoming in place, ``"drop"`` removes them.
    """
    if delete_mode not in ("keep", "drop"):
        raise ValueError("delete_mode must be 'keep' or 'drop'")
    now = F.current_timestamp() if now is None else now
    status = F.col("status")

    def column(field: T.StructField) -> Column:
        name, dtype = field.name, field.dataType
        if name in keys:
            return F.col(name)
        if name in fields:
            value = F.when(status == DELETE, F.col(f"old.{name}")).otherwise(F.col(f"new.{name}").cast(dtype))
        elif name == created:
            value = F.when(status == INSERT, now.cast(dtype)).otherwise(F.col(f"carried.{name}"))
        elif name == updated:
            value = F.when(status.isin(INSERT, UPDATE), now.cast(dtype)).otherwise(F.col(f"carried.{name}"))
        else:
            value = F.col(f"carried.{name}")
        return value.alias(name)

    kept = paired if delete_mode == "keep" else paired.filter(status != DELETE)
    return kept.select(*[column(field) for field in stored_schema.fields])


def carried_columns(stored: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> list[str]:
    return [c for c in stored.columns if c not in keys and c not in fields]


def apply_snapshot(
    stored: DataFrame, incoming: DataFrame, keys: Sequence[str], fields: Sequence[str], **how
) -> DataFrame:
    """The next stored state. Write it to a new path: the stored table is read lazily."""
    paired = pair_snapshots(stored, incoming, keys, fields, carry=carried_columns(stored, keys, fields))
    return state_of(paired, stored.schema, keys, fields, **how)


def run_result(fetched: DataFrame, counts: DataFrame) -> DataFrame:
    """Run counters from a one-row ``fetched`` count and a one-row diff count."""
    both = fetched.select(
        F.col("fetched"), *[F.lit(0).cast("long").alias(c) for c in counts.columns]
    ).unionByName(counts.withColumn("fetched", F.lit(0).cast("long")))
    total = both.agg(*[F.sum(c).alias(c) for c in both.columns])
    valid = F.col("rows_new") + F.col("rows_updated") + F.col("rows_unchanged")
    return total.select(
        "fetched",
        valid.alias("valid_incoming"),
        (F.col("rows_updated") + F.col("rows_unchanged")).alias("existing"),
        F.col("rows_new").alias("inserted"),
        F.col("rows_updated").alias("updated"),
        (F.col("fetched") - valid).alias("skipped"),
    )
