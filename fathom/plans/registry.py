"""Registry of the driver-table query bindings and their DuckDB oracle SQL."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a binding; ``sql`` is its DuckDB twin (None -> rows-only check)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every binding module (each registers its queries on import)."""
    import importlib
    for mod in BINDING_MODULES:
        importlib.import_module(f"fathom.plans.{mod}")


BINDING_MODULES = ["q_series", "q_clean", "q_encode", "q_stats", "q_prep", "q_eval", "q_combine", "q_models"]
