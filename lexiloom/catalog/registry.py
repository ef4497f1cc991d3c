"""Name -> query, and name -> DuckDB statement that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiloom.catalog.sqlviews import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, oracle: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query registered twice: {name}")
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


def render_oracles() -> None:
    """Put the derived tables in front of every statement, once all modules are loaded."""
    for name, body in ORACLES.items():
        ORACLES[name] = sql(body)
