"""Queries: nearest references, retrieval log, context lists, vector text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from snapgrade import schemas
from snapgrade.functions.vectors import text_to_vector, vector_to_text
from snapgrade.operators import cell_index, hashed_search, retrieval
from snapgrade.operators.dedupe import first_per_key
from snapgrade.plans.registry import query, table
from snapgrade.session import scratch_path
from snapgrade.sources.sinks import read_evidence, replace_stage


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every vector asks, every vector is a reference."""
    vectors = table(spark, sf, "embeddings")
    return (
        vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")),
        vectors.select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("vector")),
    )


def _found(queries: DataFrame, refs: DataFrame) -> DataFrame:
    return retrieval.topk_cosine(queries, refs, strategy=retrieval.small_refs_strategy(refs), pivots=32)


def _shown(found: DataFrame) -> DataFrame:
    return found.withColumns({"similarity": F.round("similarity", 4), "rank": F.col("rank").cast("long")})


_SCORED = "round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 9)"
_GLOBAL_SQL = f"""SELECT query_id, ref_id, round(s, 4) AS similarity, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, ref_id) AS rank FROM (
      SELECT q.vec_id AS query_id, r.vec_id AS ref_id, {_SCORED} AS s FROM embeddings q, embeddings r))
  WHERE rank <= 3"""


@query("topk_global", _GLOBAL_SQL)
def topk_global(spark: SparkSession, sf: str) -> DataFrame:
    """Every reference to every task while they fit a broadcast, else by pivots."""
    return _shown(_found(*_sides(spark, sf)))


@query("topk_global_pivots", _GLOBAL_SQL)
def topk_global_pivots(spark: SparkSession, sf: str) -> DataFrame:
    """The same by the default way, with nothing broadcast but pivots."""
    return _shown(retrieval.topk_cosine(*_sides(spark, sf), pivots=32))


@query("topk_stored_cells", _GLOBAL_SQL)
def topk_stored_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The same from an index that two loads filled, the second of them tried twice."""
    queries, refs = _sides(spark, sf)
    base = scratch_path(spark, "cell-index")
    early = F.pmod(F.xxhash64("ref_id"), F.lit(2)) == 0
    cell_index.create(spark, base, refs.where(early), pivots=32)
    cell_index.append(spark, base, refs.where(early), 1)
    for _ in range(2):
        cell_index.append(spark, base, refs.where(~early), 2)
    return _shown(cell_index.search(spark, base, queries))


@query("topk_lsh_recall", "SELECT count(*) AS queries, true AS enough FROM embeddings")
def topk_lsh_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the search by hashing finds nine tenths of the exact search's rows or more."""
    queries, refs = _sides(spark, sf)
    exact = _found(queries, refs).select("query_id", "ref_id")
    found = hashed_search.topk_hashed(queries, refs).select("query_id", "ref_id", F.lit(1).alias("hit"))
    both = exact.join(found, ["query_id", "ref_id"], "left")
    return both.agg(
        F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough")
    )


def _own_label(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf, "embeddings")
    refs = vectors.select(F.col("label").alias("entity"), F.col("vec_id").alias("ref_id"), F.col("embedding").alias("vector"))
    return first_per_key(refs, ["entity"], ["ref_id"]).select("entity", "vector"), refs


_ENTITY_SQL = f"""ranked AS (SELECT entity, ref_id, s, row_number() OVER (PARTITION BY entity ORDER BY s DESC, ref_id) AS rank
  FROM (SELECT r.label AS entity, r.vec_id AS ref_id, {_SCORED} AS s FROM embeddings r JOIN (
      SELECT * FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)) q ON q.label = r.label)),
  found AS (SELECT * FROM ranked WHERE rank <= 3)"""


@query("topk_same_entity", f"WITH {_ENTITY_SQL} SELECT entity, ref_id, round(s, 4) AS similarity, rank FROM found")
def topk_same_entity(spark: SparkSession, sf: str) -> DataFrame:
    """Each label asks with its first vector among its own vectors."""
    return _shown(retrieval.topk_same_entity(*_own_label(spark, sf)))


@query(
    "retrieval_log",
    f"""SELECT 7 AS ingest_run_id, 'vector ' || query_id AS planet_name, ref_id AS reference_id, 'reference ' || ref_id AS reference_name,
      similarity AS similarity_score, false AS was_referenced, '2024-02-01 10:00:00' AS retrieved_at FROM ({_GLOBAL_SQL})""",
)
def retrieval_log(spark: SparkSession, sf: str) -> DataFrame:
    """The global search's log rows as stored by a run that was tried twice."""
    queries, refs = _sides(spark, sf)
    found = _found(queries, refs).withColumn(
        "entity", F.concat(F.lit("vector "), F.col("query_id").cast("string"))
    )
    names = refs.select("ref_id", F.concat(F.lit("reference "), F.col("ref_id").cast("string")).alias("reference_name"))
    log = retrieval.retrieval_log(found, names, run_id=7, entity="entity")
    log = log.withColumn("retrieved_at", F.lit("2024-02-01 10:00:00").cast("timestamp"))
    path = scratch_path(spark, "retrieval-log")
    for _ in range(2):
        replace_stage(log, path, schemas.RETRIEVAL_LOG, 7, "retrieval")
    stored = read_evidence(spark, path, schemas.RETRIEVAL_LOG).drop("stage")
    return stored.withColumns(
        {"similarity_score": F.round("similarity_score", 4), "retrieved_at": F.col("retrieved_at").cast("string")}
    )


@query(
    "context_lists",
    f"""WITH {_ENTITY_SQL} SELECT c_custkey, string_agg('vector ' || ref_id || '@' || rank, ';' ORDER BY rank) AS context
    FROM customer LEFT JOIN found ON entity = c_nationkey GROUP BY 1""",
)
def context_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with the context of their nation's number, if it has any."""
    queries, refs = _own_label(spark, sf)
    contents = refs.select("ref_id", F.concat(F.lit("vector "), F.col("ref_id").cast("string")).alias("content"))
    lists = retrieval.context_lists(retrieval.topk_same_entity(queries, refs), contents, entity="entity")
    shown = F.array_join(
        F.transform("context", lambda r: F.concat(r["content"], F.lit("@"), r["rank"].cast("string"))), ";"
    )
    return (
        table(spark, sf, "customer")
        .join(lists.select(F.col("entity").alias("c_nationkey"), shown.alias("context")), "c_nationkey", "left")
        .select("c_custkey", "context")
    )


@query("vector_text", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS width, true AS survives FROM embeddings")
def vector_text(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors through their text form and back."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding", vector_to_text(F.col("embedding")).alias("text"))
    back = text_to_vector(F.col("text"))
    return vectors.select(
        "vec_id", F.size(back).alias("width"), F.col("embedding").eqNullSafe(back).alias("survives")
    )
