"""Registry of named queries: a Spark builder plus, where the operator is
deterministic and SQL-expressible, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key``."""
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


QUERY_MODULES = ("q_session", "q_features", "q_clean", "q_encode", "q_split",
                 "q_metrics", "q_validate", "q_documents", "q_model", "q_surface", "q_sketch")


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib
    for m in QUERY_MODULES:
        try:
            importlib.import_module(f"{__package__}.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"{__package__}.{m}":
                raise
