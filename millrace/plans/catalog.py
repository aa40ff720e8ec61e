"""All queries by name, with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        assert name not in _QUERIES, name
        _QUERIES[name] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    _load()
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}


def _load() -> None:
    """Import the modules that register queries."""
    import importlib
    import pkgutil

    import millrace.plans as plans

    for module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.startswith("q_")):
        importlib.import_module(f"millrace.plans.{module}")
