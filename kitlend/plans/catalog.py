"""Registry of named queries: a Spark callable and, where SQL can say it, the
DuckDB oracle text over the driver's tables.

Each query reads whole tables (through the fixture mapping) so its work grows
with the data; no row caps except where the limit is the feature (top-N).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import the query modules so they register themselves."""
    import importlib
    for mod in _MODULES:
        importlib.import_module(f"kitlend.plans.{mod}")


_MODULES = ["q_balances", "q_history", "q_members", "q_notify", "q_jobs", "q_changes", "q_audit", "q_snapshots",
            "q_streaming", "q_kept"]
