"""All queries over the given tables and their DuckDB twins."""

from __future__ import annotations

from corpuslens.plans import corpus_queries, metric_queries, model_queries, token_queries, vector_queries
from corpuslens.plans.base import ORACLES, QUERIES

FLAGSHIP = "e3_direction_audit"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "corpus_queries", "metric_queries", "model_queries", "token_queries", "vector_queries"]
