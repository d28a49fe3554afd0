"""Writes: truncate-and-load, gzip extract, empty tables, partition overwrite, upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Replace the table at `path` by the result of a query, and scan it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> str:
    writer = df.write.mode("overwrite").option("header", True)
    if gzip:
        writer = writer.option("compression", "gzip")
    writer.csv(path)
    return path


def write_empty(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """Create a table with columns and no rows."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace only those partitions of `path` that have rows in `df`.

    The rows are first spread by the partition column, so one day is written by a few
    tasks instead of every task opening every day. AQE splits an oversized day.
    """
    (
        df.hint("rebalance", by).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by).parquet(path)
    )


def upsert(state: DataFrame, batch: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows of `batch` replace rows of `state` with the same key; the rest stay.

    `batch` holds one row per key (see `latest_per_key`). The result is a new table:
    the caller writes it to a new version and never over what it reads.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return state.join(batch.select(*keys), keys, "left_anti").unionByName(batch)
