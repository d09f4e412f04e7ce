"""Queries over whole tables: near-duplicates, document fingerprints, similarity join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snapgrade.llm import jaccard, simhash, winnow
from snapgrade.llm.registry import query, table


@query("op9_simhash_components")
def op9_simhash_components(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's fingerprint and the smallest doc_id that links reach."""
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", simhash.hex_text("fp").alias("fingerprint"), "component_id")


@query("op2_winnowing")
def op2_winnowing(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return winnow.fingerprints(table(spark, sf, "documents"))


@query(
    "op11_jaccard_components",
    r"""
    WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')) END) AS s FROM words),
    grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n + b.n) AS n FROM grams a JOIN grams b USING (g)
      WHERE a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY ALL),
    links AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (n - c)),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id, doc_id AS other FROM documents
      UNION SELECT doc_id, b FROM reach JOIN both_ways ON other = a)
    SELECT doc_id, len(any_value(s))::BIGINT AS n_shingles, min(other) AS component_id FROM sets JOIN reach USING (doc_id) GROUP BY doc_id""",
)
def op11_jaccard_components(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's number of shingles and the smallest doc_id that links of 80 percent or more reach."""
    return jaccard.jaccard_components(table(spark, sf, "documents"))
