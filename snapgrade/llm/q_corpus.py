"""Queries over whole tables: mixing, packing, token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from snapgrade.llm import lengths, mixing, packing
from snapgrade.llm.registry import query, table


@query("op1_harmonic_packing")
def op1_harmonic_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    pieces = packing.pack(table(spark, sf, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query(
    "op5_source_mix",
    r"""
    WITH sized AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
    sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    ranked AS (
      SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
             row_number() OVER (ORDER BY encode(source) NULLS LAST) AS pos FROM sums),
    levels AS (
      SELECT *, 2 * source_size / weight AS ratio,
        (1.5::DOUBLE * (SELECT sum(source_size) FROM sums)
          - coalesce(sum(2 * source_size) OVER before, 0)::DOUBLE)
        / ((SELECT sum(weight) FROM ranked) - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
      FROM ranked
      WINDOW before AS (ORDER BY 2 * source_size / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    goals AS (
      SELECT source, source_size,
        least((SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, pos LIMIT 1) * weight,
              2.0::DOUBLE * source_size) AS target FROM levels),
    placed AS (
      SELECT s.doc_id, s.size, g.source_size, g.target,
        floor(g.target)::BIGINT // greatest(g.source_size, 1) AS epochs,
        floor(g.target)::BIGINT % greatest(g.source_size, 1) AS rest,
        coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
    SELECT doc_id, size::BIGINT AS size, source_size, target,
           (size * epochs + greatest(0, least(size, rest - before)))::BIGINT AS taken
    FROM placed""",
)
def op5_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Words taken of each document when the sources weigh 5, 2, 1 in turn."""
    mixed = mixing.mix(table(spark, sf, "documents"))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


@query("op8_length_histogram")
def op8_length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Every encoded length of the documents with its suffix sums."""
    return lengths.suffix_table(lengths.length_histogram(table(spark, sf, "documents")))
