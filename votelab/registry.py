"""Named queries: ``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> DuckDB SQL``.

Every query reads the driver's tables (through the fixture views derived from them) and runs over
whole tables and whole texts. Doubles are rounded to 6 digits on both sides (sum order differs).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | Callable[[], str] | None = None):
    """Decorator: register a query function under ``name`` with its oracle SQL (or none)."""
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle() if callable(oracle) else oracle
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from .plans import queries, queries_io, queries_models, queries_ops, queries_text  # noqa: F401
