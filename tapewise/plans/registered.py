"""All registered queries of the analytics library."""

from __future__ import annotations

from . import bar_queries, check_queries, file_queries, more_queries, pattern_queries, registry_queries, research_queries, review_queries, stream_queries, study_queries, zone_queries  # noqa: F401  they register themselves
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
