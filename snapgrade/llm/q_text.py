"""Queries over whole tables: secrets, language, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from snapgrade.llm import ctw, language, secrets
from snapgrade.llm.registry import query, table


@query("op4_secret_spans")
def op4_secret_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets of every document, counted by base kind, with all spans."""
    found = secrets.scan_secrets(table(spark, sf, "documents").select("doc_id", "text"))
    base = F.col("secrets.base")
    count = lambda rank: F.size(F.filter(base, lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"),
        secrets.spans_text(F.col("secrets.spans")).alias("spans"),
    )


@query("op6_language_centroids")
def op6_language_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted language of every document, learned from three quarters of them."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = language.fit(docs.where(~held_out))
    found = language.predict(docs, model)
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
        F.col("language.rejected").alias("rejected"),
    )


@query("op3_context_tree_scores")
def op3_context_tree_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Code lengths of every document by a context tree that six sevenths of them teach."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return ctw.score_texts(docs, held_out)
