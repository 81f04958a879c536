"""All registered queries; importing the modules registers theirs."""

from quillon.plans import helper_queries, host_queries, ingest_queries, practice_queries, source_queries, state_queries, text_queries  # noqa: F401
from quillon.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
