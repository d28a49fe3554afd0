"""Queries of this folder and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, root: str) -> DataFrame:
            # Workers of a session that was started elsewhere find this package; a cluster gets it with --py-files.
            spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
            return fn(spark, root)

        QUERIES[key] = run
        if sql:
            ORACLE[key] = sql
        return fn

    return register
