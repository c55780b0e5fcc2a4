"""Named queries and, where SQL can express them, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cyclewise import config
from cyclewise.plans import views

Query = Callable[[views.Fleet], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = fn
        if sql is not None:
            _sql[name] = f"WITH {views.SQL}\n{sql.strip()}"
        return fn

    return register


def _bind(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(views.Fleet(config.prepare(spark), sf_dir))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(fn) for name, fn in _queries.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
