"""All queries of the core, with their oracles."""

from __future__ import annotations

from knotwork.plans import auditing, building, hierarchies, records, resolving, scoring, splitting, statistics

MODULES = [hierarchies, building, records, resolving, splitting, auditing, scoring, statistics]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
