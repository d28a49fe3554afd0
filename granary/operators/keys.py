"""Declared primary and foreign keys, kept as column metadata.

A declaration is not enforced: it says what the table's maker promises, travels with the
columns through projections and through stored tables, and is checked by `violations`.
Steps that would only restore a declared key can be left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.quality import relationships, unique_combination

_PRIMARY, _FOREIGN = "primary_key", "foreign_key"


def _metadata(df: DataFrame, column: str) -> dict:
    return next(f.metadata for f in df.schema if f.name == column)


def declare_primary(df: DataFrame, *columns: str) -> DataFrame:
    """`df` with the promise that no two rows share these columns and none of them is null."""
    for c in columns:
        df = df.withMetadata(c, {**_metadata(df, c), _PRIMARY: list(columns)})
    return df


def declare_foreign(df: DataFrame, column: str, parent: str, parent_column: str) -> DataFrame:
    """`df` with the promise that every value of `column` that is not null is one of `parent`.`parent_column`."""
    return df.withMetadata(column, {**_metadata(df, column), _FOREIGN: [parent, parent_column]})


def primary(df: DataFrame) -> list[str]:
    """The declared key, if all its columns are still there under their names; else none.

    A key holds for as long as rows are only dropped; after a join or union declare anew.
    """
    for f in df.schema:
        key = list(f.metadata.get(_PRIMARY, []))
        if key and all(c in df.columns and list(_metadata(df, c).get(_PRIMARY, [])) == key for c in key):
            return key
    return []


def foreign(df: DataFrame) -> dict[str, tuple[str, str]]:
    """Column -> (parent table, parent column)."""
    return {f.name: tuple(f.metadata[_FOREIGN]) for f in df.schema if _FOREIGN in f.metadata}


def undeclared(df: DataFrame) -> DataFrame:
    """`df` without its declarations, for results in which they need not hold."""
    for f in df.schema:
        if _PRIMARY in f.metadata or _FOREIGN in f.metadata:
            df = df.withMetadata(f.name, {k: v for k, v in f.metadata.items() if k not in (_PRIMARY, _FOREIGN)})
    return df


def distinct_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The distinct values of `columns`; no aggregate where they hold the declared key."""
    key = primary(df)
    rows = df.select(*columns)
    return rows if key and set(key) <= set(columns) else rows.distinct()


def look_up(fact: DataFrame, column: str, parent: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns of the parent for each fact row (left join), once per row.

    The parent's declared key makes it single-valued; without one the parent is reduced to
    its smallest row per value first.
    """
    key = primary(parent)
    single = parent if len(key) == 1 else None
    name = key[0] if single is not None else column
    if single is None:
        single = parent.groupBy(name).agg(F.min(F.struct(*columns)).alias("__row")).select(name, *[F.col("__row")[c].alias(c) for c in columns])
    single = undeclared(single.select(F.col(name).alias("__key"), *columns))
    return fact.join(single, F.col(column) == F.col("__key"), "left").drop("__key")


def violations(df: DataFrame, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """(rule, value, n): what breaks the declarations; `parents` holds the tables that foreign keys name."""
    key = primary(df)
    text = lambda cs: F.to_json(F.struct(*cs), {"ignoreNullFields": "false"})
    found = []
    if key:
        twice = unique_combination(undeclared(df), key)
        found.append(twice.select(F.lit("primary").alias("rule"), text(key).alias("value"), "n"))
        empty = df.where(" or ".join(f"`{c}` is null" for c in key))
        found.append(empty.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).select(F.lit("null in primary").alias("rule"), text(key).alias("value"), "n"))
    for column, (parent, parent_column) in foreign(df).items():
        if parents is None or parent not in parents:
            raise KeyError(f"the parent table {parent!r} of {column!r} was not given")
        orphans = relationships(df, column, parents[parent], parent_column).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        found.append(orphans.select(F.lit(f"foreign {column}").alias("rule"), text([column]).alias("value"), "n"))
    if not found:
        return df.sparkSession.createDataFrame([], "rule string, value string, n long")
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out
