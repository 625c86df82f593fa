"""All queries of the library and the SQL that checks them, gathered from the plans."""

from __future__ import annotations

from parchment.plans import PLANS


def queries() -> dict:
    return {name: query for plan in PLANS for name, query in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in plan.ORACLE_SQL.items()}
