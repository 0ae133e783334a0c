"""The registered queries, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules beside this one that register queries.
MODULES = ("graph", "quality", "changes", "crossref", "search", "logs", "catalog")

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under a name, with the DuckDB SQL for its rows."""

    def keep(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"two queries are named {name}")
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return keep


def _load() -> None:
    for name in MODULES:
        import_module(f"kgspark.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
