"""Registered queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake.plans.oracle import with_views
from tracelake.plans.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a function of `Views`; `sql` is the same question over the SQL views."""

    def register(build: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Views(spark, folder))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_views(list(views), sql)
        return build

    return register
