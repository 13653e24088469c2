"""The registered queries."""

from modwarden.plans import corpus_queries, page_queries, store_queries, stream_queries, text_queries  # noqa: F401
from modwarden.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
