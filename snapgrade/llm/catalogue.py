"""All queries of this subpackage."""

from snapgrade.llm import q_corpus, q_dedup, q_frames, q_pages, q_quality, q_text  # noqa: F401
from snapgrade.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
