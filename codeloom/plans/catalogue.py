"""Every registered query and the SQL that gives the same rows."""

from codeloom.plans import change_queries, context_queries, extract_queries, graph_queries, lookup_queries, review_queries, stream_queries, text_queries  # noqa: F401
from codeloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
