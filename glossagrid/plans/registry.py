"""Registry of named queries and of the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """Name a SQL view that oracle texts may read."""
    VIEWS[name] = sql.strip()


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query; `views` names the SQL views its oracle reads, in order."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            parts = [f"{v} AS (\n{VIEWS[v]}\n)" for v in views.split()]
            ORACLES[name] = (("WITH " + ",\n".join(parts) + "\n") if parts else "") + sql.strip()
        return fn
    return register
