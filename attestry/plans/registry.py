"""All registered queries of the reference operators and their SQL."""

from __future__ import annotations

from attestry.plans import knowledge, retrieval, temporal

MODULES = [retrieval, temporal, knowledge]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
