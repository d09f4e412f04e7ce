"""Approximate nearest references by sign projections with several probes, ranked by exact cosines.

In each of some tables a vector's bucket is the signs of its products with random directions. References
are in one bucket a table; a query also looks into the buckets across the directions it is nearest
to. Queries and references that share a bucket are compared exactly, in blocks of bounded size, so a bucket
that holds a third of all rows is many tasks. Either every chunk of the queries meets every block of the references in a
task, which sorts both into buckets, or vectors are sent to their buckets: whatever copies fewer vectors. What is found
is right in similarity and order, but a near reference that shares no bucket with its query is missed: ``topk_cosine``
is the exact search.
"""

from __future__ import annotations

import sys
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from snapgrade.operators import retrieval
from snapgrade.operators.retrieval import _GROUP, MATRIX_CELLS, NO_SIMILARITY, RANK_DECIMALS, _dense, _true_cells
from snapgrade.session import materialise

# Task functions travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TABLES, BITS, PROBES, SEED = 12, 8, 12, 17
LEAST_BLOCKS = 8  # of either side, so that small tables are several tasks too


def _directions(width: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(tables * bits, width))


def _projected(vectors: np.ndarray, directions: np.ndarray, tables: int) -> np.ndarray:
    return (vectors @ directions.T).reshape(len(vectors), tables, -1)


def _own_codes(products: np.ndarray) -> np.ndarray:
    return (products > 0) @ (1 << np.arange(products.shape[2]))


def _probed_codes(products: np.ndarray, probes: int) -> np.ndarray:
    """(vector, table, probe): the own bucket and those across at most two directions, the least distance first."""
    bits = products.shape[2]
    flips = [(), *((i,) for i in range(bits)), *combinations(range(bits), 2)]
    inside = np.array([[i in f for i in range(bits)] for f in flips], float)
    masks = np.array([sum(1 << i for i in f) for f in flips])
    cost = products**2 @ inside.T
    best = np.argsort(cost, axis=2, kind="stable")[:, :, :probes]
    return _own_codes(products)[:, :, None] ^ masks[best]


def _bucketed(df: DataFrame, id_column: str, directions: np.ndarray, tables: int, probes: int) -> DataFrame:
    """A row (table, code, id, vector) for every bucket a vector is in or looks into."""

    @F.pandas_udf("array<array<int>>")
    def codes(vectors: pd.Series) -> pd.Series:
        found = _probed_codes(_projected(np.vstack(vectors.to_numpy()).astype(np.float64), directions, tables), probes)
        return pd.Series([[list(map(int, t)) for t in v] for v in found])

    spread = df.select(id_column, "vector", F.posexplode(codes("vector")).alias("table", "codes"))
    return spread.select(id_column, "vector", "table", F.explode("codes").alias("code"))


def _directed(queries: DataFrame, refs: DataFrame, tables: int, bits: int, seed: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Both sides without missing vectors, and the directions."""
    # where no reference has a vector, that of the queries
    known = refs if not refs.where(F.col("vector").isNotNull()).isEmpty() else queries
    width = retrieval.vector_width(known)
    directions = _directions(width, tables, bits, seed)
    return retrieval.with_vectors(queries, "query_id", width), retrieval.with_vectors(refs, "ref_id", width), directions


def _sides(queries: DataFrame, refs: DataFrame, tables: int, bits: int, probes: int, seed: int) -> tuple[DataFrame, DataFrame]:
    asked, known, directions = _directed(queries, refs, tables, bits, seed)
    return _bucketed(asked, "query_id", directions, tables, probes), _bucketed(known, "ref_id", directions, tables, 1)


def _sizes(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Buckets that both sides have, with their rows: 2^bits × tables at most."""
    count = lambda df, name: df.groupBy("table", "code").agg(F.count(F.lit(1)).alias(name))
    return count(asked, "asked").join(count(known, "known"), ["table", "code"])


def _by_code(codes: np.ndarray) -> dict[int, np.ndarray]:
    """Rows of every code."""
    order = np.argsort(codes, kind="stable")
    found, starts = np.unique(codes[order], return_index=True)
    return dict(zip(found.tolist(), np.split(order, starts[1:])))


def _reached(sims: np.ndarray, k: int) -> np.ndarray:
    """A similarity that k references of every row reach, for more than k: the k-th best, or that of groups of references."""
    group = _GROUP
    if sims.shape[1] >= 4 * group * k:
        sims = sims[:, : sims.shape[1] // group * group]
        while group > 1:
            sims, group = np.maximum(*np.split(sims, 2, axis=1)), group // 2
    at = sims.shape[1] - k
    return np.partition(sims, at, axis=1)[:, at]


def _sharing(directions: np.ndarray, tables: int, probes: int):
    """The k best of the references that share a bucket with a query, as a function for blocks of unit vectors.

    Single precision screens: in every bucket k references reach a similarity, and one that is below the best
    of these by more than single precision can err is not among the k best. What is left is ranked exactly.
    """

    def nearest(query_ids: np.ndarray, queries: np.ndarray, ref_ids: np.ndarray, refs: np.ndarray, k: int) -> pd.DataFrame:
        # of references without a direction, which are all alike, the lowest ids are enough
        empty = np.flatnonzero(~refs.any(axis=1))
        spare = empty[np.argsort(ref_ids[empty], kind="stable")[k:]]
        ref_ids, refs = np.delete(ref_ids, spare), np.delete(refs, spare, axis=0)
        empty = ~refs.any(axis=1)
        id_order = np.empty(len(ref_ids), dtype=np.int64)
        id_order[np.argsort(ref_ids, kind="stable")] = np.arange(len(ref_ids))
        codes = _own_codes(_projected(refs, directions, tables))
        asked = np.concatenate(
            [_probed_codes(_projected(queries[at : at + 4096], directions, tables), probes) for at in range(0, len(queries), 4096)]
        )
        directed = queries.any(axis=1)
        turned = np.flatnonzero(directed)
        few, short = queries.astype(np.float32), refs.astype(np.float32)
        slack = np.float32(4 * (queries.shape[1] + 8) * np.finfo(np.float32).eps)
        least = np.full(len(queries), -np.inf, dtype=np.float32)
        rows, cols = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def keep(row: np.ndarray, col: np.ndarray) -> None:
            rows.append(row)
            cols.append(col)

        def compare(row: np.ndarray, col: np.ndarray) -> None:
            sims = few[row] @ short[col].T
            sims[:, empty[col]] = NO_SIMILARITY
            if len(col) > k:
                least[row] = np.maximum(least[row], _reached(sims, k) - slack)
            mask = sims >= least[row][:, None]
            if np.count_nonzero(mask) * 8 > mask.size and len(col) > 8 * k:
                best, _ = _dense(queries[row], refs[col], id_order[col], k)
                keep(np.repeat(row, k), col[best].ravel())
            else:
                r, c = np.divmod(_true_cells(mask), len(col))
                keep(row[r], col[c])

        for table in range(tables):
            known, seen = _by_code(codes[:, table]), asked.shape[2]
            # a query looks into a bucket once
            for code, places in _by_code(asked[directed, table].ravel()).items():
                if code not in known:
                    continue
                row, col = turned[places // seen], known[code]
                step = max(1, MATRIX_CELLS // len(col))
                for at in range(0, len(row), step):
                    compare(row[at : at + step], col)
        # queries without a direction are all alike and have one bucket a probe: the lowest ids in it
        alike = np.flatnonzero(~directed)
        if len(alike):
            met = (codes[:, :, None] == asked[alike[0]]).any(axis=(1, 2))
            col = np.flatnonzero(met)
            col = col[np.argsort(id_order[col])[:k]]
            keep(np.repeat(alike, len(col)), np.tile(col, len(alike)))
        row, col = np.divmod(np.unique(np.concatenate(rows) * len(ref_ids) + np.concatenate(cols)), len(ref_ids))
        exact = np.empty(len(row))
        for at in range(0, len(row), 1 << 16):
            to = slice(at, at + (1 << 16))
            exact[to] = np.einsum("ij,ij->i", queries[row[to]], refs[col[to]])
        exact = np.round(exact, RANK_DECIMALS)
        exact[empty[col] | ~directed[row]] = NO_SIMILARITY
        order = np.lexsort((id_order[col], -np.rint(exact * 10**RANK_DECIMALS), row))
        row, col, exact = row[order], col[order], exact[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        return pd.DataFrame({"query_id": query_ids[row[best]], "ref_id": ref_ids[col[best]], "score": exact[best]})

    return nearest


def _by_blocks(
    asked: DataFrame, known: DataFrame, directions: np.ndarray, tables: int, probes: int, blocks: int, chunks: int, k: int, schema
) -> DataFrame:
    """Every chunk of the queries meets every block of the references; a pair meets once."""
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    query_side = asked.withColumn("chunk", dealt("query_id", chunks)).withColumn("block", every(blocks))
    ref_side = known.withColumn("block", dealt("ref_id", blocks)).withColumn("chunk", every(chunks))
    return retrieval.rank_dealt(query_side, ref_side, ("block", "chunk"), k, schema, _sharing(directions, tables, probes))


def topk_hashed(
    queries: DataFrame, refs: DataFrame, k: int = retrieval.TOP_K, *, tables: int = TABLES, bits: int = BITS,
    probes: int = PROBES, seed: int = SEED, block_rows: int | None = None,
) -> DataFrame:
    """``(query_id, ref_id, similarity, rank)``: the k nearest among the references that share a bucket.

    ``queries(query_id, vector)``, ``refs(ref_id, vector)``. A query that meets fewer than k references has fewer
    rows. More tables or probes find more and compare more; more bits do the contrary. A vector is copied to
    the blocks of the other side, or to its buckets if those are fewer. A vector without a direction has no similarity.
    """
    if not 1 <= bits <= 30 or tables < 1 or probes < 1:
        raise ValueError("tables and probes must be positive, bits between 1 and 30")
    width = retrieval.vector_width(refs)
    schema = retrieval.pair_schema(queries, refs)
    rows, asking, kept = block_rows or 2 * retrieval.rows_of_block(width), queries.count(), refs.count()
    blocks, chunks = (max(LEAST_BLOCKS, -(-n // rows)) for n in (kept, asking))
    if asking * blocks + kept * chunks <= tables * (asking * probes + kept):
        asked, known, directions = _directed(queries, refs, tables, bits, seed)
        return retrieval.ranked(_by_blocks(asked, known, directions, tables, probes, blocks, chunks, k, schema), k)
    asked, known = _sides(queries, refs, tables, bits, probes, seed)
    asked, known = materialise(asked, "asked"), materialise(known, "known")
    rows = block_rows or retrieval.rows_of_block(width)
    cut = lambda n: F.ceil(F.col(n) / rows).cast("int")
    layout = _sizes(asked, known).select("table", "code", cut("known").alias("blocks"), cut("asked").alias("chunks"))
    pairs = retrieval.rank_blocks(asked, known, layout, ["table", "code"], k, schema)
    # a pair may meet in several tables, its rounded score then differs in the last place at most
    once = pairs.groupBy("query_id", "ref_id").agg(F.max("score").alias("score"))
    return retrieval.ranked(once, k)


def compared_share(
    queries: DataFrame, refs: DataFrame, *, tables: int = TABLES, bits: int = BITS, probes: int = PROBES, seed: int = SEED
) -> DataFrame:
    """One row: comparisons that the search makes (repeats in further tables included) over all pairs."""
    sizes = _sizes(*_sides(queries, refs, tables, bits, probes, seed))
    made = sizes.agg(F.sum(F.col("asked") * F.col("known")).alias("made"))
    both = queries.agg(F.count(F.lit(1)).alias("q")).withColumn("r", refs.agg(F.count(F.lit(1))).scalar())
    return both.select((made.scalar() / (F.col("q") * F.col("r"))).alias("share"))
