"""Query registry: name -> (Spark callable, DuckDB SQL twin or None)."""

from __future__ import annotations

import importlib

from tessera.registry.base import REGISTRY, Query  # noqa: F401

_MODULES = [
    "profile_q",
    "cleaning_q",
    "numeric_q",
    "category_q",
    "dates_q",
    "rows_q",
    "aggregate_q",
    "windows_q",
    "stats_q",
    "features_q",
    "io_q",
]

_loaded = False


def load() -> dict[str, Query]:
    global _loaded
    if not _loaded:
        for m in _MODULES:
            importlib.import_module(f"tessera.registry.{m}")
        _loaded = True
    return REGISTRY


def queries():
    return {k: q.fn for k, q in load().items()}


def oracle_sql():
    return {k: q.sql for k, q in load().items() if q.sql}
