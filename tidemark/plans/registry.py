"""Every query on the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.bindings import PRELUDE, Views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, plain: bool = False):
    """Register a function of the views under its name; ``sql`` reads the views unless it is ``plain``."""

    def add(f: Callable[[Views], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = sql if plain else (PRELUDE + sql.replace("WITH ", ", ", 1) if sql.lstrip().startswith("WITH ") else PRELUDE + sql)
        return f

    return add


def _load() -> None:
    from tidemark.plans import evidence, flows, landings, lexicons, listings, state_queries, texts  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
