"""Registry of the named queries and of the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, table folder) -> DataFrame under `key`."""

    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key!r} registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return register


def open_ended(key: str, sql: str) -> Callable[[Query], Query]:
    """Register a history whose `valid_to` may be 9999-12-31.

    The query shows `valid_to` as text, because clients that hold times in nanoseconds
    (pandas) cannot take that date. The operators themselves return timestamps.
    """
    text = f"select * replace (strftime(valid_to, '%Y-%m-%d %H:%M:%S.%f') as valid_to) from ({sql})"

    def register(fn: Query) -> Query:
        query(key, text)(lambda spark, root: fn(spark, root).withColumn("valid_to", F.date_format("valid_to", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
        return fn

    return register
