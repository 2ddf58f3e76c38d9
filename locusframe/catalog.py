"""Registered queries over the given tables, and the SQL that DuckDB runs for each."""

from __future__ import annotations

from .plans import interval_queries, metric_queries, model_queries, sequence_queries, source_queries, whole_queries  # noqa: F401  they register their queries
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
