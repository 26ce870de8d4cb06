"""Registry of named queries: a DataFrame function and, where SQL can say it, the equivalent SQL."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name`` with its SQL."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def load() -> None:
    """Import every module that registers queries."""
    import importlib
    import pkgutil

    import counterlens.queries as package

    for mod in pkgutil.iter_modules(package.__path__):
        if mod.name not in ("base", "registry"):
            importlib.import_module(f"counterlens.queries.{mod.name}")
