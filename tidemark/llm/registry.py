"""The queries of the training-data operators, over their whole tables, and SQL where it can say the same."""

from __future__ import annotations

from tidemark.llm import queries as q


def queries() -> dict:
    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(q.SQL)
