"""Queries over the pages table: archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from snapgrade.llm import warc
from snapgrade.llm.registry import query, table
from snapgrade.session import scratch_path


@query(
    "op10_warc_round_trip",
    """
    WITH paid AS (
      SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest FROM pages),
    firsts AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM paid)
    SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
      array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          ((('0x' || substr(digest, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '')
        AS payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> first THEN first END AS refers_to
    FROM firsts""",
)
def op10_warc_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every page as read back from an archive that was written of all pages."""
    path = scratch_path(spark, "archive")
    warc.write_archive(table(spark, sf, "pages"), path)
    records = warc.read_archive(spark, path)
    return records.select(
        "page_id",
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_length")).alias("payload_bytes"),
        F.coalesce(warc.base32_sha1(F.col("payload")), F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
