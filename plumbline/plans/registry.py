"""Queries of the core by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; ``sql`` is its counterpart for another engine, where there is one."""

    def add(f: Query) -> Query:
        if f.__name__ in _queries:
            raise ValueError(f"two queries {f.__name__}")
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    import importlib
    import pkgutil

    import plumbline.plans as here

    for m in sorted(pkgutil.iter_modules(here.__path__), key=lambda m: m.name):
        if m.name.startswith("q_"):
            importlib.import_module(f"plumbline.plans.{m.name}")
    return dict(_queries), dict(_sql)
