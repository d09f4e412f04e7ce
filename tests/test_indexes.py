"""Nearest k from the stored cell index, and by hashing."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows
from snapgrade.operators import cell_index, hashed_search, retrieval
from test_retrieval import brute_force, clustered, sides


def shown(found):
    return rows(found.withColumn("similarity", F.round("similarity", 6)))


def test_loads_attempts_and_null_vectors(spark, tmp_path):
    rng = np.random.default_rng(7)
    queries, refs = clustered(rng, 10), clustered(rng, 200)
    asked, known = sides(spark, queries, refs)
    base = str(tmp_path / "index")
    first, second = known.where("ref_id < 220"), known.where("ref_id >= 220")
    assert cell_index.search(spark, base, asked).collect() == []  # not created yet
    cell_index.create(spark, base, first, pivots=7, most_k=4)
    assert cell_index.search(spark, base, asked).collect() == []
    cell_index.append(spark, base, first.withColumn("vector", F.lit(None).cast("array<float>")), 1)
    cell_index.append(spark, base, first, 1)  # in place of what it was first given
    cell_index.append(spark, base, known.where("false"), 2)
    cell_index.append(spark, base, second, 3)
    assert cell_index.loads(spark, base) == {1: 2, 2: 1, 3: 1}
    assert shown(cell_index.search(spark, base, asked, block_rows=30)) == brute_force(queries, refs, 3)
    assert shown(cell_index.search(spark, base, asked, upto=2)) == brute_force(queries, refs[:120], 3)
    with pytest.raises(ValueError, match="at most"):
        cell_index.search(spark, base, asked, 5)
    # cells of an attempt that never got its summary rows don't count
    spark.read.parquet(f"{base}/cells/load=3").drop("attempt").write.partitionBy("cell").parquet(f"{base}/cells/load=4/attempt=1")
    assert shown(cell_index.search(spark, base, asked)) == brute_force(queries, refs, 3)


def test_only_routed_cells_are_read(spark, tmp_path):
    rng = np.random.default_rng(2)
    vectors = clustered(rng, 400)[6:]
    _, known = sides(spark, vectors[:1], vectors)
    base = str(tmp_path / "index")
    cell_index.create(spark, base, known, pivots=24)
    cell_index.append(spark, base, known, 1)
    near = clustered(np.random.default_rng(2), 400)[10:12]
    asked, _ = sides(spark, near, near)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        found = cell_index.search(spark, base, asked)
        plan = plan_of(found)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = [p for p in re.findall(r"PartitionFilters: \[([^\]]*)", plan) if "cell#" in p]
    read = set(re.findall(r"\d+", re.search(r"cell#\d+ IN(?:SET | \()([\d, ]+)", " ".join(filters)).group(1)))
    assert 0 < len(read) < spark.read.parquet(f"{base}/cells").select("cell").distinct().count() * 0.7
    assert shown(found) == brute_force(near, vectors, 3)


def test_an_index_without_directions(spark, tmp_path):
    refs = [[0.0] * 4] * 3
    asked, known = sides(spark, [[1.0, 0, 0, 0], [0.0] * 4], refs)
    base = str(tmp_path / "index")
    cell_index.create(spark, base, known)
    cell_index.append(spark, base, known, 1)
    assert shown(cell_index.search(spark, base, asked, 2)) == brute_force([[1.0, 0, 0, 0], [0.0] * 4], refs, 2)


def test_hashing_finds_most_and_compares_few(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    vectors = centres[rng.integers(0, 40, 1200)] + rng.normal(scale=0.1, size=(1200, 16))
    vectors[3] = 0
    queries, known = sides(spark, vectors[:60], vectors)
    exact = {r[:2] for r in brute_force(vectors[:60], vectors, 3) if r[2] is not None}
    found = hashed_search.topk_hashed(queries, known, block_rows=100)
    got = rows(found)
    assert len(exact & {r[:2] for r in got}) >= 0.9 * len(exact)
    assert sorted(r[3] for r in got if r[0] == 7) == [1, 2, 3]
    # what is found has the exact similarity
    unit = vectors.astype(np.float32).astype(float)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    assert all(abs(s - unit[q] @ unit[r - 100]) < 1e-8 for q, r, s, _ in got if s is not None)
    few = {"tables": 4, "bits": 10, "probes": 8}
    assert hashed_search.compared_share(queries, known, **few).first().share < 0.2
    assert len(exact & {r[:2] for r in rows(hashed_search.topk_hashed(queries, known, **few))}) >= 0.9 * len(exact)
    assert "CartesianProduct" not in plan_of(found) and "NestedLoop" not in plan_of(found)


def sharing_by_force(queries, ids, refs, directions, tables, probes, k):
    """The k best (similarity, id) among the references that share a bucket, from all pairs."""
    queries, refs = (retrieval._unit(np.asarray(v, float)) for v in (queries, refs))
    own = hashed_search._own_codes(hashed_search._projected(refs, directions, tables))
    asked = hashed_search._probed_codes(hashed_search._projected(queries, directions, tables), probes)
    sims, found = retrieval._similarities(queries, refs), []
    for i in range(len(queries)):
        met = np.flatnonzero((own[:, :, None] == asked[i][None]).any(axis=(1, 2)))
        found += [(i, b, -a) for a, b in sorted((-sims[i, j], ids[j]) for j in met)[:k]]
    return found


def test_blocks_find_what_shares_a_bucket():
    """Copies, vectors without a direction, fewer references than asked for."""
    rng = np.random.default_rng(5)
    some, empty = rng.normal(size=(700, 16)), np.zeros((40, 16))
    hot = np.repeat(some[:2], 400, axis=0)
    cases = [(some[:150], some, 3), (np.vstack([empty, some[:60]]), np.vstack([some, empty]), 5), (hot[::9], np.vstack([hot, some]), 3), (some[:20], some[:2], 4)]
    for tables, bits, probes in ((12, 8, 12), (2, 3, 2)):
        directions = hashed_search._directions(16, tables, bits, 1)
        nearest = hashed_search._sharing(directions, tables, probes)
        for queries, refs, k in cases:
            ids = rng.permutation(len(refs)) + 1000
            got = nearest(np.arange(len(queries)), retrieval._unit(queries), ids, retrieval._unit(refs), k)
            want = sharing_by_force(queries, ids, refs, directions, tables, probes, k)
            assert list(zip(got.query_id, got.ref_id, got.score)) == want


def test_hashing_copies_vectors_to_blocks_or_to_buckets(spark, monkeypatch):
    """A vector goes to the blocks of the other side, not to every bucket it looks into; both ways find the same."""
    vectors = np.random.default_rng(6).normal(size=(300, 8))
    queries, known = sides(spark, vectors, vectors)
    by_blocks = hashed_search.topk_hashed(queries, known)
    plan = plan_of(by_blocks)
    assert "code" not in plan and "chunk" in plan and "NestedLoop" not in plan
    monkeypatch.setattr(hashed_search, "LEAST_BLOCKS", 1000)
    by_buckets = hashed_search.topk_hashed(queries, known)
    assert "code" in plan_of(by_buckets) and shown(by_blocks) == shown(by_buckets)


def test_hashing_no_rows_and_wrong_settings(spark):
    queries, known = sides(spark, [[1.0, 0.0]], [[1.0, 0.0]])
    assert hashed_search.topk_hashed(queries, known.where("false")).collect() == []
    assert hashed_search.topk_hashed(queries.where("false"), known).collect() == []
    (one,) = hashed_search.topk_hashed(queries, known.withColumn("vector", F.lit(None).cast("array<float>")), tables=2, bits=1, probes=2).collect()
    assert (one.similarity, one.rank) == (None, 1)
    with pytest.raises(ValueError):
        hashed_search.topk_hashed(queries, known, bits=0)
