"""All queries of the engine's own operators, and the SQL they are held against."""

from __future__ import annotations

from groundwork.plans import corpus, graph, review

MODULES = (corpus, graph, review)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.S.items()}
