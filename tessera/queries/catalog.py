"""All queries of the core, gathered from their modules."""

from __future__ import annotations

from collections.abc import Callable

from tessera.queries import language, mapping, paging, problems, profiles, scalars, store, surface, workload, writes

MODULES = (problems, language, store, profiles, mapping, paging, workload, surface, writes, scalars)


def queries() -> dict[str, Callable]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
