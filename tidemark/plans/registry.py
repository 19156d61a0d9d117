"""Every registered query of the shoreline engine and its SQL twin."""

from __future__ import annotations

from tidemark.plans import change_queries, profile_queries, space_queries, sql_queries

MODULES = (change_queries, profile_queries, space_queries, sql_queries)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
