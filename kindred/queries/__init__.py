"""The driver's queries for the linkage operators."""

from __future__ import annotations

from . import clustering, pairs, profiling, records, scores, upkeep
from .registry import QUERIES, SQL, Query

__all__ = ["clustering", "oracle_sql", "pairs", "profiling", "queries", "records", "scores", "upkeep"]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
