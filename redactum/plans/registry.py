"""All library queries and their oracle SQL, by name."""

from __future__ import annotations

from redactum.plans import catalog_queries, curation_queries, environment_queries, frontier_queries, lattice_queries, model_queries, pluggable_queries, qa_queries, span_queries, text_queries  # noqa: F401
from redactum.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
