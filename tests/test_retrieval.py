import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows
from snapgrade.operators import retrieval


def sides(spark, queries, refs):
    q = [(i, [float(x) for x in v]) for i, v in enumerate(queries)]
    r = [(100 + i, [float(x) for x in v]) for i, v in enumerate(refs)]
    return (
        spark.createDataFrame(q, "query_id long, vector array<float>").repartition(3),
        spark.createDataFrame(r, "ref_id long, vector array<float>").repartition(3),
    )


def brute_force(queries, refs, k):
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else None
    out = []
    for qi, q in enumerate(np.asarray(queries, np.float32).astype(float)):
        scored = []
        for ri, r in enumerate(np.asarray(refs, np.float32).astype(float)):
            a, b = unit(q), unit(r)
            s = None if a is None or b is None else round(float(a @ b), 9)
            scored.append((-(s if s is not None else -2.0), 100 + ri, s))
        for rank, (_, ref, s) in enumerate(sorted(scored)[:k], 1):
            out.append((qi, ref, None if s is None else round(s, 6), rank))
    return sorted(out, key=repr)


def clustered(rng, rows_, dim=8, hot=0.4):
    """Tight clusters, one with much of the rows, exact copies, and vectors without a direction."""
    centres = rng.normal(size=(6, dim))
    which = np.where(rng.random(rows_) < hot, 0, rng.integers(0, 6, rows_))
    vectors = centres[which] + rng.normal(scale=0.05, size=(rows_, dim))
    vectors[1] = vectors[0] * 2
    vectors[2] = 0
    vectors[5] = vectors[4]
    return vectors


WAYS = {
    "references broadcast": {"strategy": "broadcast_refs"},
    "queries broadcast": {"strategy": "broadcast_queries"},
    "pivots": {"pivots": 8, "block_rows": 40},
    "one pivot": {"pivots": 1, "block_rows": 7},
}


@pytest.mark.parametrize("way", WAYS)
def test_all_ways_are_exact(spark, way):
    rng = np.random.default_rng(11)
    queries, refs = clustered(rng, 12), clustered(rng, 300)
    found = retrieval.topk_cosine(*sides(spark, queries, refs), k=3, **WAYS[way])
    assert rows(found.withColumn("similarity", F.round("similarity", 6))) == brute_force(queries, refs, 3)


@pytest.mark.parametrize("way", WAYS)
def test_few_and_directionless_references(spark, way):
    for refs in ([[0.0] * 8], [[0.0] * 8, [1.0] + [0.0] * 7]):
        queries = [[1.0] * 8, [0.0] * 8]
        found = retrieval.topk_cosine(*sides(spark, queries, refs), k=3, **WAYS[way])
        assert rows(found.withColumn("similarity", F.round("similarity", 6))) == brute_force(queries, refs, 3)


@pytest.mark.parametrize("way", WAYS)
def test_ids_may_be_strings(spark, way):
    rng = np.random.default_rng(3)
    queries, refs = clustered(rng, 8), clustered(rng, 90)
    asked, known = sides(spark, queries, refs)
    named = lambda df, c: df.withColumn(c, F.format_string("%04d", F.col(c)))
    found = retrieval.topk_cosine(named(asked, "query_id"), named(known, "ref_id"), k=3, **WAYS[way])
    wanted = [(f"{q:04d}", f"{r:04d}", s, rank) for q, r, s, rank in brute_force(queries, refs, 3)]
    assert rows(found.withColumn("similarity", F.round("similarity", 6))) == sorted(wanted, key=repr)


def test_no_references(spark):
    queries, refs = sides(spark, [[1.0, 0.0]], [[1.0, 0.0]])
    assert retrieval.topk_cosine(queries, refs.filter("false")).collect() == []


def test_pivots_prune_and_no_group_exceeds_its_block(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = clustered(rng, 400)[6:]
    queries, refs = sides(spark, vectors[:40], vectors)
    sizes = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    plain = retrieval._nearest

    def counted(query_ids, query_units, ref_ids, ref_units, k):
        assert len(query_ids) <= 2 * 50 and len(ref_ids) <= 2 * 50  # blocks are dealt by hash
        sizes[0].add(len(query_ids) * len(ref_ids))
        sizes[1].add(1)
        return plain(query_ids, query_units, ref_ids, ref_units, k)

    monkeypatch.setattr(retrieval, "_nearest", counted)
    found = retrieval.topk_cosine(queries, refs, pivots=24, block_rows=50)
    plan = plan_of(found)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert len(found.collect()) == 3 * 40
    assert sizes[1].value > 3 and sizes[0].value < 0.7 * 40 * len(vectors)


def test_a_broadcast_above_its_budget_is_refused(spark):
    both = sides(spark, [[1.0, 0.0]] * 9, [[1.0, 0.0]] * 9)
    for strategy in retrieval.STRATEGIES[1:]:
        with pytest.raises(ValueError, match="above"):
            retrieval.topk_cosine(*both, strategy=strategy, broadcast_bytes=64)
    with pytest.raises(ValueError):
        retrieval.topk_cosine(*both, pivots=0)


def test_a_hot_entity_is_ranked_in_parts(spark):
    rng = np.random.default_rng(5)
    refs = [("hot" if i % 5 else f"e{i % 25}", i, rng.normal(size=4).tolist()) for i in range(2000)]
    frame = spark.createDataFrame(refs, "entity string, ref_id long, vector array<float>").repartition(8)
    queries = spark.createDataFrame([(e, [1.0, 0.5, 0.0, -1.0]) for e in sorted({r[0] for r in refs})], "entity string, vector array<float>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = retrieval.topk_same_entity(queries, frame)
        plan = plan_of(found)
        got = rows(found.select("entity", "ref_id", "rank"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # ranked by part behind an exchange of its own, and limited again before the last one
    assert re.search(r"Exchange hashpartitioning\(entity#\d+, _salt#\d+", plan)
    assert re.search(r"WindowGroupLimit \[entity#\d+\][^\n]*Partial", plan)
    q = np.array([1.0, 0.5, 0.0, -1.0])
    score = lambda v: round(float(np.float32(v).astype(float) @ q / np.linalg.norm(np.float32(v).astype(float)) / np.linalg.norm(q)), 9)
    wanted = []
    for e in {r[0] for r in refs}:
        best = sorted((-score(v), i) for entity, i, v in refs if entity == e)[:3]
        wanted += [(e, i, rank) for rank, (_, i) in enumerate(best, 1)]
    assert got == sorted(wanted, key=repr)


def test_same_entity(spark):
    refs = spark.createDataFrame(
        [("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 1.0]), ("a", 3, [1.0, 1.0]), ("a", 4, [0.0, 0.0]), ("b", 5, [0.0, 1.0])],
        "entity string, ref_id long, vector array<float>",
    )
    queries = spark.createDataFrame([("a", [1.0, 0.0]), ("c", [1.0, 0.0])], "entity string, vector array<float>")
    found = retrieval.topk_same_entity(queries, refs, k=4)
    assert [(r.ref_id, r.rank) for r in found.orderBy("rank").collect()] == [(1, 1), (3, 2), (2, 3), (4, 4)]
    assert "WindowGroupLimit" in plan_of(found)


def test_context_and_log(spark):
    found = spark.createDataFrame([("a", 2, 0.5, 2), ("a", 1, 0.9, 1)], "entity string, ref_id long, similarity double, rank int")
    names = spark.createDataFrame([(1, "one", "c1"), (2, "two", "c2")], "ref_id long, reference_name string, content string")
    (row,) = retrieval.context_lists(found, names, entity="entity").collect()
    assert [(c["rank"], c["content"], c["similarity"]) for c in row.context] == [(1, "c1", 0.9), (2, "c2", 0.5)]
    log = retrieval.retrieval_log(found, names, run_id=4, entity="entity").orderBy("reference_id").collect()
    assert [tuple(r) for r in log] == [(4, "a", 1, "one", 0.9, False), (4, "a", 2, "two", 0.5, False)]


def test_screened_search_equals_the_dense_one():
    rng = np.random.default_rng(4)
    refs = retrieval._unit(rng.normal(size=(900, 12)))
    refs[100:140] = refs[7]  # copies: ties by id
    refs[300:310] = 0.0
    queries = np.vstack([refs[:60], retrieval._unit(rng.normal(size=(60, 12)))])
    order = rng.permutation(900)
    best, sims = retrieval._dense(queries, refs, order, 5)
    found = retrieval._screened(queries, refs, refs.astype(np.float32), order, 5)
    assert (found[0] == best).all() and np.allclose(found[1], sims, rtol=0, atol=2e-9)
    # where nearly all are alike, screening gives up
    assert retrieval._screened(queries[:9], refs[[7] * 900], refs[[7] * 900].astype(np.float32), order, 5) is None


def test_references_above_the_budget_are_searched_by_pivots(spark, monkeypatch):
    from snapgrade.plans import q_retrieval

    queries, refs = sides(spark, [[1.0, 0.0], [0.6, 0.8]], [[1.0, 0.1], [0.0, 1.0], [1.0, 1.0], [0.5, 0.5]])
    wanted = rows(q_retrieval._found(queries, refs))
    assert retrieval.small_refs_strategy(refs) == "broadcast_refs" and retrieval.small_refs_strategy(refs, 32) == "pivots"
    monkeypatch.setattr(retrieval, "small_refs_strategy", lambda refs, most=32, of=retrieval.small_refs_strategy: of(refs, most))
    assert rows(q_retrieval._found(queries, refs)) == wanted and len(wanted) == 6


def test_screening_holds_no_matrix_of_all_pairs_and_finds_late_copies():
    import tracemalloc

    rng = np.random.default_rng(6)
    refs = retrieval._unit(rng.normal(size=(20_001, 16)))
    refs[15_000:15_050] = refs[3]  # ties of a later tile
    queries = np.vstack([refs[:40], retrieval._unit(rng.normal(size=(160, 16)))])
    order = rng.permutation(len(refs))
    short = refs.astype(np.float32)
    tracemalloc.start()
    found = retrieval._screened(queries, refs, short, order, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    best, sims = retrieval._dense(queries, refs, order, 3)
    assert (found[0] == best).all() and np.allclose(found[1], sims, rtol=0, atol=2e-9)
    assert peak < 200 * 20_001 * 4  # one single-precision matrix of all pairs


def test_search_by_slices_and_tiles_equals_the_dense_one(monkeypatch):
    rng = np.random.default_rng(8)
    refs = retrieval._unit(np.repeat(rng.normal(size=(90, 8)), 40, axis=0) + rng.normal(scale=0.05, size=(3600, 8)))
    refs[50:90], refs[2000:2030] = refs[7], 0.0
    queries = np.vstack([refs[::9], np.zeros((1, 8))])
    ids, ref_ids = np.arange(len(queries)), rng.permutation(3600)
    sorted_rows = lambda df: df.sort_values(["query_id", "score", "ref_id"], ascending=[True, False, True]).to_numpy()
    monkeypatch.setattr(retrieval, "SLICE", 64)
    monkeypatch.setattr(retrieval, "TILE", 256)
    got = sorted_rows(retrieval._nearest(ids, queries, ref_ids, refs, 3))
    monkeypatch.setattr(retrieval, "_screened", lambda *all: None)
    wanted = sorted_rows(retrieval._nearest(ids, queries, ref_ids, refs, 3))
    assert (got[:, :2] == wanted[:, :2]).all() and np.allclose(got, wanted, rtol=0, atol=2e-9)


def test_vectors_of_unlike_widths_are_refused():
    import pyarrow as pa

    with pytest.raises(ValueError, match="one width"):
        retrieval._table_matrix(pa.chunked_array([[[1.0, 2.0], [3.0]], [[4.0, 5.0, 6.0]]]))
    assert retrieval._table_matrix(pa.chunked_array([[[1.0, 2.0]], [[3.0, None]]])).shape == (2, 2)
