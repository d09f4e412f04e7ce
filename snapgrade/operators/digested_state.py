"""A stored state with digests of its key cells: a diff pairs only the cells that differ.

Keys are hashed to parts (folders) and, inside a part, to cells. Beside the rows the state keeps one digest per
cell: the number of rows, the xor of one row hash and the sum of another, over keys and compared fields. A
snapshot is digested the same way in one aggregate without a shuffle of its rows; cells whose digests agree
hold the same rows, and only rows of the other cells are read, shuffled and paired.

Two different cells pass for equal only if as many rows agree in the xor of one 64-bit hash and in the sum of
another: about one in 2**128 for rows that were not made to collide (the hashes are not cryptographic). A hash
that differs for equal values costs a pairing and no more.

A version is data of the parts that changed, digests and places (which version holds which part), and a commit
row, in this order. Without its commit row nothing of a version is seen, and the next attempt replaces it. The driver
gets part numbers only, at most ``parts`` of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from snapgrade.operators.diff import UNCHANGED, changes_of, counts_of, pair_snapshots, state_of
from snapgrade.session import materialise

_CELL = ["_part", "_cell"]
_DIGEST = T.StructType(
    [
        T.StructField("_part", T.IntegerType()),
        T.StructField("_cell", T.IntegerType()),
        T.StructField("rows", T.LongType()),
        T.StructField("xored", T.LongType()),
        T.StructField("added", T.DecimalType(38, 0)),
    ]
)
_PLACE = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("version", T.LongType())])
_COMMIT = T.StructType([T.StructField("version", T.LongType()), T.StructField("layout", T.StringType())])
FILES_PER_PART = 4


@dataclass(frozen=True)
class Comparison:
    """What a snapshot changes in a state: pairs of the differing cells, and the rows of all others."""

    cells: DataFrame  # _part, _cell of the cells that differ
    parts: list[int]  # the parts they are in
    paired: DataFrame
    equal_rows: DataFrame  # one row: rows in cells that do not differ
    keys: tuple[str, ...]

    def changes(self) -> DataFrame:
        return changes_of(self.paired, self.keys)

    def counts(self) -> DataFrame:
        """As ``diff_counts``: rows of cells that were not paired are unchanged ones."""
        counted = counts_of(self.paired)
        names = counted.columns
        others = self.equal_rows.select(
            *[(F.col("rows") if c == "rows_unchanged" else F.lit(0)).cast("long").alias(c) for c in names]
        )
        return counted.unionByName(others).agg(*[F.sum(c).alias(c) for c in names])


@dataclass(frozen=True)
class DigestedState:
    """The state at ``path``. Keys are unique and not null, in the state and in every snapshot.

    ``schema`` has the keys, the compared ``fields`` and whatever else a row carries. ``parts`` bounds what is
    rewritten when little changes, ``cells`` (per part) what is paired: with r rows a cell and a share c of rows
    changed at random, 1 - (1 - c)**r of the cells differ. Both are fixed when the state is made.
    """

    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    fields: tuple[str, ...]
    parts: int = 64
    cells: int = 4096

    def __post_init__(self) -> None:
        missing = [c for c in (*self.keys, *self.fields) if c not in self.schema.names]
        if missing or not self.keys or not self.fields:
            raise ValueError(f"keys and fields must be columns of the state, missing: {missing}")
        if self.parts < 1 or self.cells < 1:
            raise ValueError("parts and cells must be at least 1")
        clash = [c for c in self.schema.names if c in ("_part", "_cell", "version")]
        if clash:
            raise ValueError(f"columns named like those of the layout: {clash}")

    # reading

    def version(self, spark: SparkSession) -> int | None:
        """The last committed version; None before the first."""
        try:
            commits = spark.read.schema(_COMMIT).json(f"{self.path}/commits")
            last = commits.agg(F.max_by(F.struct("version", "layout"), "version").alias("last")).first()["last"]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        if last is None:
            return None
        if last["layout"] != self._layout():
            raise ValueError(f"the state at {self.path} was made with other settings: {last['layout']}")
        return last["version"]

    def read(self, spark: SparkSession, parts: Sequence[int] | None = None) -> DataFrame:
        """The rows of the last committed version, of the given parts only if they are given."""
        return self._placed(spark, parts).select(*self._columns())

    def digests(self, spark: SparkSession) -> DataFrame:
        version = self.version(spark)
        if version is None:
            return spark.createDataFrame([], _DIGEST)
        return spark.read.schema(_DIGEST).parquet(f"{self.path}/digests/version={version}")

    # comparing and writing

    def compare(self, incoming: DataFrame) -> Comparison:
        """Differing cells and their pairs, written once. ``incoming`` is read twice: give a table."""
        spark = incoming.sparkSession
        self._check_types(incoming)
        marked = self._marked(incoming.select(*[F.col(f"`{c}`") for c in (*self.keys, *self.fields)]))
        stored, arrived = self.digests(spark), _digest(marked)
        values = [f.name for f in _DIGEST.fields if f.name not in _CELL]
        old, new = F.struct(*[F.col(f"o.{v}") for v in values]), F.struct(*[F.col(f"n.{v}") for v in values])
        cells = materialise(
            stored.alias("o").join(arrived.alias("n"), _CELL, "full_outer").filter(~old.eqNullSafe(new)).select(*_CELL),
            "cells",
        )
        parts = sorted(row[0] for row in cells.select("_part").distinct().collect())
        mine = self._marked(self.read(spark, parts)).join(cells, _CELL, "left_semi")
        theirs = marked.filter(F.col("_part").isin(parts)).join(cells, _CELL, "left_semi")
        paired = pair_snapshots(mine, theirs, self.keys, self.fields, carry=[*self._carried(), *_CELL])
        equal = stored.join(cells, _CELL, "left_anti").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
        return Comparison(cells, parts, materialise(paired, "pairs"), equal, self.keys)

    def replace(self, rows: DataFrame) -> None:
        """Make ``rows`` the state: a version in which every part is new."""
        spark = rows.sparkSession
        version = self.version(spark)
        self._write(rows, 0 if version is None else version + 1, list(range(self.parts)))

    def advance(
        self,
        incoming: DataFrame,
        *,
        now: Column | None = None,
        created: str | None = None,
        updated: str | None = None,
        delete_mode: str = "keep",
    ) -> Comparison:
        """Compare and commit the next version, as ``apply_snapshot``; parts without a change stay where they are.

        Keys kept in the state though the snapshot lacks them are deletes in every comparison, so their cells differ.
        """
        spark = incoming.sparkSession
        version = self.version(spark)
        found = self.compare(incoming)
        moved = found.paired if delete_mode == "drop" else found.paired.filter(F.col("status") != "DELETE")
        if version is not None and moved.filter(F.col("status") != UNCHANGED).isEmpty():
            return found
        how = dict(now=now, created=created, updated=updated, delete_mode=delete_mode)
        changed = state_of(found.paired, self.schema, self.keys, self.fields, **how)
        rest = self._marked(self.read(spark, found.parts)).join(found.cells, _CELL, "left_anti").select(*self._columns())
        self._write(changed.unionByName(rest), 0 if version is None else version + 1, found.parts)
        return found

    # layout

    def _layout(self) -> str:
        return f"{self.schema.simpleString()} by {','.join(self.keys)} on {','.join(self.fields)}: {self.parts} x {self.cells}"

    def _columns(self) -> list[Column]:
        return [F.col(f"`{c}`") for c in self.schema.names]

    def _carried(self) -> list[str]:
        return [c for c in self.schema.names if c not in self.keys and c not in self.fields]

    def _check_types(self, incoming: DataFrame) -> None:
        for name in (*self.keys, *self.fields):
            have, want = incoming.schema[name].dataType, self.schema[name].dataType
            if have != want:
                raise ValueError(f"{name} is {have.simpleString()}, the state has {want.simpleString()}: cast it first")

    def _marked(self, rows: DataFrame) -> DataFrame:
        """Rows with part, cell and two row hashes. Nulls are marked, as hashing passes over them."""
        place = F.xxhash64(*[F.col(f"`{k}`") for k in self.keys])
        values = [F.col(f"`{k}`") for k in self.keys]
        for name in self.fields:
            values += [F.col(f"`{name}`").isNull(), F.col(f"`{name}`")]
        return rows.select(
            "*",
            F.pmod(place, F.lit(self.parts)).cast("int").alias("_part"),
            F.pmod(F.shiftrightunsigned(place, 32), F.lit(self.cells)).cast("int").alias("_cell"),
            F.xxhash64(F.lit(1), *values).alias("_xored"),
            F.xxhash64(F.lit(2), *values).alias("_added"),
        )

    def _placed(self, spark: SparkSession, parts: Sequence[int] | None) -> DataFrame:
        version = self.version(spark)
        whole = T.StructType([*self.schema.fields, *_PLACE.fields])
        if version is None:
            return spark.createDataFrame([], whole)
        held: dict[int, list[int]] = {}
        for part, at in self._places(spark, version).collect():
            if parts is None or part in parts:
                held.setdefault(at, []).append(part)
        wanted = F.lit(False)
        for at, its in sorted(held.items()):
            wanted = wanted | ((F.col("version") == at) & F.col("_part").isin(its))
        return spark.read.schema(whole).parquet(f"{self.path}/data").filter(wanted)

    def _places(self, spark: SparkSession, version: int) -> DataFrame:
        return spark.read.schema(_PLACE).parquet(f"{self.path}/places/of={version}")

    def _write(self, rows: DataFrame, version: int, parts: list[int]) -> None:
        spark = rows.sparkSession
        data, last = f"{self.path}/data/version={version}", self.version(spark)
        marked = self._marked(rows.select(*self._columns()))
        spread = marked.repartition("_part", F.pmod("_cell", F.lit(FILES_PER_PART)))
        spread.select(*self._columns(), "_part").write.mode("overwrite").partitionBy("_part").parquet(data)
        written = spark.read.schema(T.StructType([*self.schema.fields, _PLACE["_part"]])).parquet(data)
        digests = _digest(self._marked(written.select(*self._columns())))
        places = spark.createDataFrame([(p, version) for p in parts], _PLACE)
        if last is not None:
            digests = digests.unionByName(self.digests(spark).filter(~F.col("_part").isin(parts)))
            places = places.unionByName(self._places(spark, last).filter(~F.col("_part").isin(parts)))
        digests.write.mode("overwrite").parquet(f"{self.path}/digests/version={version}")
        places.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/places/of={version}")
        commit = spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(self._layout()).alias("layout"))
        commit.coalesce(1).write.mode("append").json(f"{self.path}/commits")


def _digest(marked: DataFrame) -> DataFrame:
    return marked.groupBy(*_CELL).agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor("_xored").alias("xored"),
        F.sum(F.col("_added").cast("decimal(20,0)")).cast("decimal(38,0)").alias("added"),
    )
