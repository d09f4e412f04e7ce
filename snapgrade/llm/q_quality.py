"""Queries over whole tables: quality rules by host."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snapgrade.llm import hostrules
from snapgrade.llm.registry import query, table

_RULES = {
    "few_words": "n_words < 10",
    "repeats": "n_repeat_words * 100 > n_words * 20",
    "symbols": "n_symbols > n_words",
    "dup_lines": "n_dup_lines > n_lines * 0.5::DOUBLE",
    "word_length": "n_words > 0 AND (word_chars / greatest(n_words, 1) < 2 OR word_chars / greatest(n_words, 1) > 15)",
}


def _rate_failed(rule: str) -> str:
    mean = f"((SELECT sum({rule}) FROM hosts) / (SELECT sum(n) FROM hosts))"
    square = f"(SELECT sum(n * ({rule} / n) * ({rule} / n)) / sum(n) FROM hosts)"
    variance = f"greatest({square} - {mean} * {mean}, 0)"
    strength = (
        f"(SELECT CASE WHEN {variance} > 0 "
        f"THEN least(greatest({mean} * (1 - {mean}) / {variance} - 1, 1), 10000) ELSE 10000 END)"
    )
    return f"({rule} + {mean} * {strength}) / (n + {strength}) > 0.5"


@query(
    "op7_host_rules",
    rf"""
    WITH texts AS (
      SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    places AS (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM texts),
    windows AS (
      SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(words[i:i + 4], ' ')) AS n FROM places),
    repeats AS (
      SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM windows, range(5) AS r(k) WHERE n > 1 GROUP BY rid),
    parts AS (
      SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
      FROM texts),
    ordered AS (
      SELECT rid, row_number() OVER (PARTITION BY rid, line ORDER BY pos) AS nth FROM parts
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    lines AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (nth > 1) AS n_dup_lines FROM ordered GROUP BY rid),
    stats AS (
      SELECT t.rid, doc_id, source, len(words)::BIGINT AS n_words,
        length(array_to_string(words, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM texts t LEFT JOIN repeats USING (rid) LEFT JOIN lines USING (rid)),
    ruled AS (SELECT *, {", ".join(f"({sql})::BIGINT AS {rule}" for rule, sql in _RULES.items())} FROM stats),
    hosts AS (
      SELECT source, count(*) AS n, {", ".join(f"sum({rule})::BIGINT AS {rule}" for rule in _RULES)}
      FROM ruled GROUP BY source),
    verdicts AS (SELECT source, {" OR ".join(_rate_failed(rule) for rule in _RULES)} AS host_failed FROM hosts)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
      few_words + repeats > 0 AS base_failed, host_failed,
      {" + ".join(_RULES)} = 0 AND NOT host_failed AS kept
    FROM ruled r JOIN verdicts v ON r.source IS NOT DISTINCT FROM v.source""",
)
def op7_host_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and verdicts of every document, its source being the host."""
    judged = hostrules.judge_documents(table(spark, sf, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", "kept"
    )
