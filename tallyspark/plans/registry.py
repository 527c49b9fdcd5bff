"""Where named queries and their SQL are put."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.sources.roles import Survey, with_roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str, *roles: str):
    """Registers a function of a Survey under a name, with its SQL."""

    def put(build):
        QUERIES[name] = lambda spark, folder: build(Survey(spark, folder))
        if sql:
            SQL[name] = with_roles(sql, *roles) if roles else sql
        return build

    return put
