"""Nearest references by cosine, exact.

The caller names the way; the default scales with both sides:

* ``pivots``: a pivot search. References are assigned to their nearest pivot (cells), and by the
  triangle inequality on angles a query is sent only to cells that can still hold one of its
  k nearest. Cells and the queries sent to them are cut into blocks of bounded size, so one
  cell holding most rows is many tasks. Nothing is sampled away: the result is the exact one.
* ``broadcast_refs``: every task ranks its queries against all references;
* ``broadcast_queries``: every task ranks its references for all queries, k rows per query and
  task are shuffled and merged.

A broadcast is refused, not replaced, when its side is above the budget. The cells can also be stored with
the references (``cell_index``), and an approximate search by hashing is in ``hashed_search``.

Similarities are ranked after rounding to 9 decimals, ties by id. A vector without a direction
has no similarity (null) and comes last.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F, types as T

from snapgrade.functions.vectors import dot, norm
from snapgrade.session import materialise

# Task functions travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOP_K = 3
RANK_DECIMALS = 9
NO_SIMILARITY = -2.0  # below every cosine; shown as null

BROADCAST_BYTES = 32 << 20
PIVOTS = 256  # default number of pivots
SALTS = 64  # parts in which an entity's references are ranked
BLOCK_BYTES = 8 << 20  # of vectors per side of one task
MATRIX_CELLS = 4 << 20
SLICE, TILE = 512, 2048  # queries and references of one product, so that its cells stay in the processor's cache
_GROUP = 16  # references of which the best is taken to screen the others; a power of two
_SLACK = 1e-6  # radians; covers rounding of angles and of ranked similarities


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64)


def _table_matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The same from an Arrow column, without an object per row."""
    rows = column.combine_chunks()
    widths = np.unique(rows.value_lengths())
    if len(widths) != 1:
        raise ValueError(f"vectors of one width wanted, not of {widths.tolist()}")
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), widths[0]).astype(np.float64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; rows without a direction become zero rows."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def _similarities(queries: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Rounded cosines of unit rows; zero rows get the lowest mark."""
    sims = np.round(queries @ refs.T, RANK_DECIMALS)
    sims[~queries.any(axis=1), :] = NO_SIMILARITY
    sims[:, ~refs.any(axis=1)] = NO_SIMILARITY
    return sims


def _dense(queries: np.ndarray, refs: np.ndarray, id_order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(reference, similarity) of the k best of each query, from all similarities.

    Rounded similarity and id order are packed into one whole number per pair, so a partial
    sort settles ties exactly.
    """
    sims = _similarities(queries, refs)
    keys = -np.rint(sims * 10**RANK_DECIMALS).astype(np.int64) * len(refs) + id_order
    cols = np.argpartition(keys, k - 1, axis=1)[:, :k]
    best = np.take_along_axis(cols, np.argsort(np.take_along_axis(keys, cols, axis=1), axis=1), axis=1)
    return best, np.take_along_axis(sims, best, axis=1)


def _true_cells(mask: np.ndarray) -> np.ndarray:
    """Positions of the few true cells in the flattened mask: 64 cells are one word, and words without any are passed over."""
    flat = mask.reshape(-1)
    whole = len(flat) // 64 * 64
    words = np.flatnonzero(np.packbits(flat[:whole]).view(np.uint64))
    at, bit = np.divmod(np.flatnonzero(flat[:whole].reshape(-1, 64)[words].reshape(-1)), 64)
    return np.concatenate([words[at] * 64 + bit, whole + np.flatnonzero(flat[whole:])])


def _screened(
    queries: np.ndarray, refs: np.ndarray, short: np.ndarray, id_order: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray] | None:
    """The same from exact similarities of those only that single precision leaves; None if it leaves too many.

    References come in tiles. Those of the first are taken in k groups or more: the k-th of the groups' best
    similarities is one that k references reach, so one of any tile below it by more than single precision
    can err is not among the k best. ``short`` is ``refs`` in single precision.
    """
    count, width = refs.shape
    empty = ~short.any(axis=1)  # rows of length 1 or 0
    asked = queries.astype(np.float32)
    tile = max(TILE, 4 * _GROUP * k)
    rows, cols = [], []
    left, most = 0, len(asked) * count // 8
    product = np.empty(len(asked) * min(tile, count), dtype=np.float32)
    above = np.empty(len(product), dtype=bool)
    for start in range(0, count, tile):
        part = short[start : start + tile]
        size = len(asked) * len(part)
        sims = np.matmul(asked, part.T, out=product[:size].reshape(len(asked), -1))
        sims[:, empty[start : start + tile]] = NO_SIMILARITY
        if not start:
            best = sims[:, : len(part) // _GROUP * _GROUP]
            for _ in range(_GROUP.bit_length() - 1):  # halves: a group's members are as far apart as there are groups
                best = np.maximum(*np.split(best, 2, axis=1))
            reached = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k]
            least = (reached - 4 * (width + 8) * np.finfo(np.float32).eps)[:, None]
        mask = np.greater_equal(sims, least, out=above[:size].reshape(sims.shape))
        left += np.count_nonzero(mask)
        if left > most:
            return None
        row, col = np.divmod(_true_cells(mask), len(part))
        rows.append(row)
        cols.append(col + start)
    row, col = np.concatenate(rows), np.concatenate(cols)
    exact = np.empty(len(row))
    for at in range(0, len(row), 1 << 16):
        to = slice(at, at + (1 << 16))
        exact[to] = np.einsum("ij,ij->i", queries[row[to]], refs[col[to]])
    exact = np.round(exact, RANK_DECIMALS)
    exact[empty[col]] = NO_SIMILARITY
    order = np.lexsort((id_order[col], -np.rint(exact * 10**RANK_DECIMALS), row))
    first = np.searchsorted(row[order], np.arange(len(queries)))[:, None] + np.arange(k)
    found = order[first]
    return col[found], exact[found]


def _nearest(
    query_ids: np.ndarray, queries: np.ndarray, ref_ids: np.ndarray, refs: np.ndarray, k: int
) -> pd.DataFrame:
    """The k best references (similarity down, id up) of every query among the given ones.

    Queries are taken in slices to bound the matrix in memory, references in an order without a meaning, so
    that the first of them screen the others also where like ones come together.
    """
    count = len(ref_ids)
    k = min(k, count)
    if not k or not len(query_ids):
        return pd.DataFrame({"query_id": query_ids[:0], "ref_id": ref_ids[:0], "score": np.zeros(0)})
    mixed = np.random.default_rng(count).permutation(count)
    ref_ids, refs = ref_ids[mixed], refs[mixed]
    id_order = np.empty(count, dtype=np.int64)
    id_order[np.argsort(ref_ids, kind="stable")] = np.arange(count)
    short = refs.astype(np.float32)
    step = max(SLICE, SLICE * TILE // count)
    parts = []
    for start in range(0, len(query_ids), step):
        asked = queries[start : start + step]
        # single precision pays for many references; a query without a direction is like all of them
        screen = count >= 4 * _GROUP * k and asked.any(axis=1).all()
        found = _screened(asked, refs, short, id_order, k) if screen else None
        if found:
            parts.append(found)
        else:
            few = max(1, MATRIX_CELLS // count)
            parts += [_dense(asked[at : at + few], refs, id_order, k) for at in range(0, len(asked), few)]
    best, sims = (np.concatenate(column).ravel() for column in zip(*parts))
    return pd.DataFrame({"query_id": np.repeat(query_ids, k), "ref_id": ref_ids[best], "score": sims})


def _ids(column: pd.Series) -> np.ndarray:
    return column.to_numpy()


def _fits(df: DataFrame, width: int, budget: int) -> bool:
    """Whether all vectors of ``df`` fit the budget; looks at no more rows than needed."""
    most = budget // (8 * max(width, 1))
    return df.select(F.lit(1)).limit(most + 1).count() <= most


def pair_schema(queries: DataFrame, refs: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("ref_id", refs.schema["ref_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _collected(df: DataFrame, id_column: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a side whose size was checked."""
    local = df.select(id_column, "vector").toPandas()
    return _ids(local[id_column]), _unit(_matrix(local["vector"]))


def _rank_against_refs(queries: DataFrame, refs: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    shared = queries.sparkSession.sparkContext.broadcast(_collected(refs, "ref_id"))

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ref_ids, ref_units = shared.value
        for batch in batches:
            if len(batch):
                yield _nearest(_ids(batch["query_id"]), _unit(_matrix(batch["vector"])), ref_ids, ref_units, k)

    return queries.select("query_id", "vector").mapInPandas(rank, schema)


def _rank_for_queries(queries: DataFrame, refs: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    shared = queries.sparkSession.sparkContext.broadcast(_collected(queries, "query_id"))

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, query_units = shared.value
        best: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch):
                continue
            found = _nearest(query_ids, query_units, _ids(batch["ref_id"]), _unit(_matrix(batch["vector"])), k)
            best = found if best is None else pd.concat([best, found])
            best = best.sort_values(["query_id", "score", "ref_id"], ascending=[True, False, True])
            best = best.groupby("query_id", sort=False).head(k)
        if best is not None:
            yield best

    return refs.select("ref_id", "vector").mapInPandas(rank, schema)


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def choose_pivots(refs: DataFrame, count: int) -> np.ndarray:
    """A repeatable choice spread over the table: the lowest id hashes (``count`` rows)."""
    directed = refs.filter(F.exists("vector", lambda x: x != 0))
    chosen = directed.select("vector").orderBy(F.xxhash64("ref_id"), "ref_id").limit(count).toPandas()
    return _unit(_matrix(chosen["vector"])) if len(chosen) else np.zeros((0, 0))


def assigned_cells(refs: DataFrame, pivots: np.ndarray) -> DataFrame:
    """References (ref_id, vector) with the nearest pivot as their cell, and the angle to it."""

    @F.pandas_udf("cell int, angle double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        units = _unit(_matrix(vectors))
        angles = _angles(units, pivots)
        cell = angles.argmin(axis=1)
        # a row without a direction is never near: count it as an angle that prunes nothing
        angle = np.where(units.any(axis=1), angles[np.arange(len(cell)), cell], np.pi)
        return pd.DataFrame({"cell": cell.astype(np.int32), "angle": angle})

    return refs.select("ref_id", "vector", nearest("vector").alias("near")).select(
        "ref_id", "vector", "near.cell", "near.angle"
    )


def cell_summary(assigned: DataFrame, k: int) -> DataFrame:
    """Per cell: rows, widest angle, the k smallest angles.

    Each task sums its cells up to one row per cell, so the summary has at most
    pivots × tasks rows before its aggregation and one row per pivot after it.
    """

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: dict[int, list] = {}
        for batch in batches:
            for cell, angles in batch.groupby("cell")["angle"]:
                entry = rows.setdefault(cell, [0, 0.0, []])
                entry[0] += len(angles)
                entry[1] = max(entry[1], angles.max())
                entry[2] = sorted(entry[2] + angles.nsmallest(k).tolist())[:k]
        if rows:
            yield pd.DataFrame(
                [(c, n, far, near) for c, (n, far, near) in rows.items()], columns=["cell", "rows", "far", "near"]
            )

    return merged_cells(assigned.select("cell", "angle").mapInPandas(summarise, CELL_SUMMARY), k)


CELL_SUMMARY = "cell int, rows long, far double, near array<double>"


def merged_cells(partial: DataFrame, k: int) -> DataFrame:
    """One row per cell from summaries of parts of it."""
    return partial.groupBy("cell").agg(
        F.sum("rows").alias("rows"),
        F.max("far").alias("far"),
        F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"),
    )


def _pivot_search(
    queries: DataFrame, refs: DataFrame, k: int, schema: T.StructType, pivot_count: int, block_rows: int
) -> DataFrame:
    pivots = choose_pivots(refs, pivot_count)
    if not len(pivots):
        # no reference has a direction: every similarity is null and the lowest ids win
        lowest = refs.select("ref_id").orderBy("ref_id").limit(k).agg(F.collect_list("ref_id")).scalar()
        return queries.withColumn("_lowest", lowest).select(
            "query_id", F.explode("_lowest").alias("ref_id"), F.lit(NO_SIMILARITY).alias("score")
        )
    assigned = materialise(assigned_cells(refs, pivots), "cells")
    cells = cell_summary(assigned, k).orderBy("cell").toPandas()
    return search_cells(queries, assigned, cells, pivots, k, schema, block_rows)


def search_cells(
    queries: DataFrame, assigned: DataFrame, cells: pd.DataFrame, pivots: np.ndarray, k: int, schema: T.StructType,
    block_rows: int,
) -> DataFrame:
    """Pairs that hold the k nearest of every query; only the cells some query is sent to are read.

    ``cells`` is the summary with one row per pivot at most, ``assigned`` has ref_id, vector and cell.
    """
    cell_ids = cells["cell"].to_numpy()
    far = cells["far"].to_numpy()
    near_angle = np.concatenate([np.asarray(n, dtype=float) for n in cells["near"]])
    near_cell = np.repeat(np.arange(len(cells)), [len(n) for n in cells["near"]])
    blocks = np.ceil(cells["rows"].to_numpy() / block_rows).astype(int)
    used = pivots[cell_ids]

    @F.pandas_udf("array<int>")
    def reachable(vectors: pd.Series) -> pd.Series:
        """Cells that may hold one of the k nearest. The k-th smallest of angle(query, pivot) +
        angle(pivot, reference) bounds the k-th nearest from above; a cell whose widest
        reference still leaves a larger angle is out of reach."""
        units = _unit(_matrix(vectors))
        angles = _angles(units, used)
        reach = angles[:, near_cell] + near_angle
        kth = min(k, reach.shape[1]) - 1
        bound = np.partition(reach, kth, axis=1)[:, kth] if reach.shape[1] >= k else np.full(len(units), np.pi)
        keep = angles - far <= np.maximum(bound, 0.0)[:, None] + _SLACK
        keep[~units.any(axis=1), :] = True
        return pd.Series([cell_ids[row].tolist() for row in keep])

    # vectors are written once, and copied to their cells only by the exchange
    sent = materialise(queries.select("query_id", "vector", reachable("vector").alias("cells")), "routed")
    demand_of = sent.select(F.explode("cells").alias("cell"))
    routed = sent.select("query_id", "vector", F.explode("cells").alias("cell"))
    demand = dict(map(tuple, demand_of.groupBy("cell").count().collect()))  # one row per pivot at most
    layout = [
        (int(c), int(b), max(1, -(-demand[int(c)] // block_rows))) for c, b in zip(cell_ids, blocks) if int(c) in demand
    ]
    layout = F.broadcast(queries.sparkSession.createDataFrame(layout, "cell int, blocks int, chunks int"))
    wanted = assigned.where(F.col("cell").isin(sorted(demand)))
    return rank_blocks(routed, wanted, layout, ["cell"], k, schema)


def rank_blocks(
    asked: DataFrame, known: DataFrame, layout: DataFrame, cell: Sequence[str], k: int, schema: T.StructType
) -> DataFrame:
    """The k nearest references of every query within each cell and block.

    ``layout`` says into how many blocks a cell's references and into how many chunks its queries are cut; every
    chunk meets every block in a task of bounded size.
    """
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    query_side = (
        asked.join(layout, list(cell))
        .withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int"))
        .withColumn("block", F.explode(upto("blocks")))
        .select(*cell, "block", "chunk", "query_id", "vector")
    )
    ref_side = (
        known.join(layout, list(cell))
        .withColumn("block", F.pmod(F.xxhash64("ref_id"), F.col("blocks")).cast("int"))
        .withColumn("chunk", F.explode(upto("chunks")))
        .select(*cell, "block", "chunk", "ref_id", "vector")
    )
    return rank_dealt(query_side, ref_side, (*cell, "block", "chunk"), k, schema)


def rank_dealt(
    query_side: DataFrame, ref_side: DataFrame, at: Sequence[str], k: int, schema: T.StructType, nearest: Callable = _nearest
) -> DataFrame:
    """What ``nearest`` finds among the queries and references dealt to each place, which is a task's work."""

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = pa.schema([left.schema.field("query_id"), right.schema.field("ref_id"), ("score", pa.float64())])
        if not len(left) or not len(right):
            return ids.empty_table()
        found = nearest(
            _ids(left["query_id"].to_pandas()), _unit(_table_matrix(left["vector"])),
            _ids(right["ref_id"].to_pandas()), _unit(_table_matrix(right["vector"])), k,
        )
        return pa.Table.from_pandas(found, schema=ids, preserve_index=False)

    return query_side.groupBy(*at).cogroup(ref_side.groupBy(*at)).applyInArrow(rank, schema)


def vector_width(df: DataFrame) -> int:
    head = df.filter(F.col("vector").isNotNull()).select(F.size("vector").alias("n")).head()
    return head["n"] if head else 1


def with_vectors(df: DataFrame, id_column: str, width: int) -> DataFrame:
    """Ids and vectors; a missing vector is one without a direction."""
    nothing = F.array_repeat(F.lit(0.0).cast("float"), width)
    return df.select(id_column, F.coalesce("vector", nothing).alias("vector"))


def rows_of_block(width: int) -> int:
    return max(1024, BLOCK_BYTES // (4 * width))


STRATEGIES = ("pivots", "broadcast_refs", "broadcast_queries")


def small_refs_strategy(refs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> str:
    """``broadcast_refs`` for references that fit the budget, else the pivot search: both are exact."""
    return "broadcast_refs" if _fits(refs, vector_width(refs), broadcast_bytes) else "pivots"


def topk_cosine(
    queries: DataFrame,
    refs: DataFrame,
    k: int = TOP_K,
    *,
    strategy: str = "pivots",
    broadcast_bytes: int = BROADCAST_BYTES,
    pivots: int = PIVOTS,
    block_rows: int | None = None,
) -> DataFrame:
    """``(query_id, ref_id, similarity, rank)``: the k nearest of all references for every query.

    ``queries(query_id, vector)``, ``refs(ref_id, vector)``. ``strategy`` is one of ``STRATEGIES``;
    a broadcast side above ``broadcast_bytes`` raises. ``block_rows`` is the size the pivot search
    cuts cells and their queries to; by default as many vectors as fit ``BLOCK_BYTES``. Larger
    blocks copy vectors to fewer tasks.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if pivots < 1:
        raise ValueError("the pivot search needs a pivot")
    schema = pair_schema(queries, refs)
    width = vector_width(refs)
    queries, refs = with_vectors(queries, "query_id", width), with_vectors(refs, "ref_id", width)
    if refs.isEmpty():
        return ranked(queries.sparkSession.createDataFrame([], schema), k)
    if strategy == "pivots":
        rows = block_rows or rows_of_block(width)
        return ranked(_pivot_search(queries, refs, k, schema, pivots, rows), k)
    side = refs if strategy == "broadcast_refs" else queries
    if not _fits(side, width, broadcast_bytes):
        raise ValueError(f"{strategy}: the side to broadcast is above {broadcast_bytes} bytes")
    rank = _rank_against_refs if strategy == "broadcast_refs" else _rank_for_queries
    return ranked(rank(queries, refs, k, schema), k)


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("ref_id"))
    return (
        pairs.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(
            "query_id",
            "ref_id",
            F.when(F.col("score") > NO_SIMILARITY, F.col("score")).alias("similarity"),
            "rank",
        )
    )


def topk_same_entity(queries: DataFrame, refs: DataFrame, k: int = TOP_K, *, salts: int = SALTS) -> DataFrame:
    """Nearest references of the query's own entity.

    ``queries(entity, vector)`` has one row per entity, ``refs(entity, ref_id, vector)`` many.
    Every reference meets one query, so the join gives no more rows than there are references.
    An entity's references are ranked in ``salts`` parts by their id first: scored pairs (without
    vectors) are dealt to the parts, so Spark can split a skewed join before that, and k rows per
    part reach the last exchange. Lengths are computed once per vector.
    """
    asked = queries.select("entity", "vector", norm(F.col("vector")).alias("_length"))
    known = refs.select("entity", "ref_id", F.col("vector").alias("_ref"), norm(F.col("vector")).alias("_ref_length"))
    size = F.col("_length") * F.col("_ref_length")
    score = F.round(F.when(size > 0, dot(F.col("vector"), F.col("_ref")) / size), RANK_DECIMALS)
    pairs = known.join(asked, "entity").select("entity", "ref_id", score.alias("similarity"))
    best = [F.col("similarity").desc_nulls_last(), F.col("ref_id")]
    # dealt out by hand: the join's partitioning by entity would do for the window
    salted = pairs.withColumn("_salt", F.pmod(F.xxhash64("ref_id"), F.lit(salts))).repartition("entity", "_salt")
    part = F.row_number().over(Window.partitionBy("entity", "_salt").orderBy(*best))
    near = salted.withColumn("_part_rank", part).filter(F.col("_part_rank") <= k).drop("_salt", "_part_rank")
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(*best))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def retrieval_log(found: DataFrame, references: DataFrame, *, run_id: int, entity: str) -> DataFrame:
    """Log rows of a retrieval; ``references(ref_id, reference_name)``."""
    return found.join(references.select("ref_id", "reference_name"), "ref_id").select(
        F.lit(run_id).alias("ingest_run_id"),
        F.col(entity).alias("planet_name"),
        F.col("ref_id").alias("reference_id"),
        "reference_name",
        F.col("similarity").alias("similarity_score"),
        F.lit(False).alias("was_referenced"),
    )


def context_lists(found: DataFrame, contents: DataFrame, *, entity: str, columns: Sequence[str] = ("content",)) -> DataFrame:
    """One row per entity with its references in rank order (k entries at most)."""
    wanted = F.struct("rank", *columns, "similarity")
    joined = found.join(contents.select("ref_id", *columns), "ref_id")
    return joined.groupBy(entity).agg(F.array_sort(F.collect_list(wanted)).alias("context"))
