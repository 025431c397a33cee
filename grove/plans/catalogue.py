"""All queries over the reference tables, and their SQL."""

from __future__ import annotations

from . import app_queries, fact_queries, geo_queries, identity_queries, plan_queries, string_queries

PARTS = [geo_queries, string_queries, identity_queries, fact_queries, plan_queries, app_queries]


def queries() -> dict:
    return {k: v for part in PARTS for k, v in part.Q.items()}


def oracle_sql() -> dict:
    return {k: v for part in PARTS for k, v in part.O.items()}
