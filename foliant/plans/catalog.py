"""The core's query catalogue: importing the query modules fills the registry."""

from __future__ import annotations

from foliant.plans import audit_queries, bundle_queries, corpus_queries, result_queries, routing_queries, scoring_queries  # noqa: F401
from foliant.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
