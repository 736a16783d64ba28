"""All queries of the core, by name."""

from __future__ import annotations

from . import preparation, workloads

FLAGSHIP = "pagerank_top100"
_MODULES = (workloads, preparation)


def queries() -> dict:
    return {name: f for module in _MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
