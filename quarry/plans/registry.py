"""All queries of the library proper: each is a function of (spark, folder) with, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quarry.session import send_source

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL of the same rows."""

    def add(function: Query) -> Query:
        if name in _queries:
            raise ValueError(f"two queries are named {name}")
        _queries[name] = wraps(function)(lambda spark, sf_dir: (send_source(spark), function(spark, sf_dir))[1])
        if sql is not None:
            _sql[name] = sql
        return function

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


from quarry.plans import retrieval  # noqa: E402, F401  registers its queries
from quarry.plans import corpora  # noqa: E402, F401
from quarry.plans import analyses, extensions  # noqa: E402, F401
from quarry.plans import longdocs  # noqa: E402, F401
from quarry.plans import more  # noqa: E402, F401
from quarry.plans import stores  # noqa: E402, F401
from quarry.plans import rest  # noqa: E402, F401
