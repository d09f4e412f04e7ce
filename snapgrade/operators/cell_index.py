"""References stored by cell for the pivot search: an inverted file that loads append to.

The base folder holds ``pivots`` (chosen once), ``cells/load=/attempt=/cell=`` (references with the angle to
their pivot) and ``summary`` (rows, widest angle and smallest angles per cell of a load). A search routes
its queries by the summaries and reads the cells they are sent to, nothing else; it is as exact as the
search without an index. A load counts once its summary rows are there: they are one file, written last.
A load that is appended again is a new attempt, and the latest one counts, so readers never see half a load.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from snapgrade.operators import retrieval
from snapgrade.operators.retrieval import TOP_K

MOST_K = 16  # of which the index can bound the distance

_PIVOTS = "pivot int, vector array<double>, most_k int"
_SUMMARY = f"load long, attempt int, {retrieval.CELL_SUMMARY}"
_COMMIT = -1  # the cell of the row that every load has


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def create(spark: SparkSession, base: str, refs: DataFrame, *, pivots: int = retrieval.PIVOTS, most_k: int = MOST_K) -> None:
    """Choose pivots among ``refs(ref_id, vector)`` for an index that has no loads yet.

    References without a direction can't be pivots; if there are no others, one axis is the pivot. More
    references than the pivots were chosen from make cells larger, not results wrong.
    """
    width = retrieval.vector_width(refs)
    chosen = retrieval.choose_pivots(retrieval.with_vectors(refs, "ref_id", width), pivots)
    if not len(chosen):
        chosen = np.eye(1, width)
    rows = [(i, [float(x) for x in v], most_k) for i, v in enumerate(chosen)]
    spark.createDataFrame(rows, _PIVOTS).coalesce(1).write.mode("errorifexists").parquet(f"{base}/pivots")


def _pivots(spark: SparkSession, base: str) -> tuple[np.ndarray, int]:
    rows = _read(spark, f"{base}/pivots", _PIVOTS).orderBy("pivot").collect()  # as many as were chosen
    return np.array([r.vector for r in rows]), rows[0].most_k if rows else 0


def exists(spark: SparkSession, base: str) -> bool:
    return not _read(spark, f"{base}/pivots", _PIVOTS).isEmpty()


def loads(spark: SparkSession, base: str) -> dict[int, int]:
    """The loads that count, each with its latest attempt."""
    latest = _read(spark, f"{base}/summary", _SUMMARY).groupBy("load").agg(F.max("attempt").alias("attempt"))
    return {r.load: r.attempt for r in latest.collect()}


def append(spark: SparkSession, base: str, refs: DataFrame, load: int) -> None:
    """Add ``refs(ref_id, vector)`` as a load, in place of an earlier attempt at the same load."""
    pivots, most_k = _pivots(spark, base)
    attempt = loads(spark, base).get(load, 0) + 1
    path = f"{base}/cells/load={load}/attempt={attempt}"
    placed = retrieval.assigned_cells(retrieval.with_vectors(refs, "ref_id", pivots.shape[1]), pivots)
    # a cell's rows in few files; Spark splits a cell that holds very many
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(path)
    mark = spark.createDataFrame([(_COMMIT, 0, 0.0, [])], retrieval.CELL_SUMMARY)
    rows = mark
    if not refs.isEmpty():
        rows = rows.unionByName(retrieval.cell_summary(spark.read.parquet(path).select("cell", "angle"), most_k))
    named = rows.select(F.lit(load).cast("long").alias("load"), F.lit(attempt).alias("attempt"), "*")
    named.coalesce(1).write.mode("append").parquet(f"{base}/summary")


def search(
    spark: SparkSession, base: str, queries: DataFrame, k: int = TOP_K, *, upto: int | None = None, block_rows: int | None = None
) -> DataFrame:
    """``(query_id, ref_id, similarity, rank)``: the k nearest stored references of every query, exactly.

    ``queries(query_id, vector)``; ``upto`` leaves out later loads. Only cells that a query is sent to are read.
    An index that was never created or has no loads finds nothing.
    """
    pivots, most_k = _pivots(spark, base)
    if len(pivots) and k > most_k:
        raise ValueError(f"the index bounds the {most_k} nearest at most")
    counted = {n: a for n, a in loads(spark, base).items() if upto is None or n <= upto}
    of_loads = [(F.col("load") == n) & (F.col("attempt") == a) for n, a in sorted(counted.items())]
    summary = _read(spark, f"{base}/summary", _SUMMARY).where(F.col("cell") != _COMMIT)
    cells = summary.where(reduce(or_, of_loads, F.lit(False)))
    cells = retrieval.merged_cells(cells, most_k).orderBy("cell").toPandas()  # one row per pivot at most
    if not len(cells):  # so too without pivots
        ref_id = spark.createDataFrame([], "ref_id long")
        return retrieval.ranked(spark.createDataFrame([], retrieval.pair_schema(queries, ref_id)), k)
    stored = spark.read.parquet(f"{base}/cells").where(reduce(or_, of_loads))
    width = pivots.shape[1]
    pairs = retrieval.search_cells(
        retrieval.with_vectors(queries, "query_id", width), stored, cells, pivots, k, retrieval.pair_schema(queries, stored),
        block_rows or retrieval.rows_of_block(width),
    )
    return retrieval.ranked(pairs, k)
