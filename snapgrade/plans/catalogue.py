"""All registered queries."""

from snapgrade.plans import q_diff, q_digests, q_retrieval, q_rules, q_runs, q_sources, q_texts  # noqa: F401
from snapgrade.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
