"""All queries by name, with their SQL."""

from __future__ import annotations

from fieldcheck.plans import case_queries, decision_queries, outlier_queries, run_queries


def queries() -> dict:
    return {**outlier_queries.QUERIES, **case_queries.QUERIES, **decision_queries.QUERIES, **run_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**outlier_queries.SQL, **case_queries.SQL, **decision_queries.SQL, **run_queries.SQL}
