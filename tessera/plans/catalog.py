"""Registry of every implemented query: Spark callables + DuckDB oracle SQL."""

from __future__ import annotations

import importlib

_MODULES = (
    "tessera.plans.analysis_queries",
    "tessera.plans.error_queries",
    "tessera.plans.corpus_queries",
    "tessera.plans.vector_queries",
    "tessera.plans.web_queries",
    "tessera.plans.extra_queries",
    "tessera.plans.io_queries",
)


def _load():
    queries, sql = {}, {}
    for name in _MODULES:
        mod = importlib.import_module(name)
        dup = set(queries) & set(mod.QUERIES)
        if dup:
            raise RuntimeError(f"duplicate query names: {sorted(dup)}")
        queries.update(mod.QUERIES)
        sql.update(mod.SQL)
    return queries, sql


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
