"""All queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from . import message_queries, retrieval_queries, telemetry_queries  # noqa: F401  they register themselves
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "bm25_topk"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
