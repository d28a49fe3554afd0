"""Data checks. Each returns the failing rows or keys, so an empty result is a pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators.ordered import keyed_shift


def unique(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their number."""
    return unique_combination(df.where(F.col(column).isNotNull()), [column])


def unique_combination(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Values outside the accepted ones, with their number."""
    return df.where(~F.col(column).isin(*values)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def relationships(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose key has no parent; null keys are allowed."""
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias("__parent")), F.col(column) == F.col("__parent"), "left_anti")


def expression(df: DataFrame, test: str | Column) -> DataFrame:
    """Rows for which the expression is not true."""
    condition = F.expr(test) if isinstance(test, str) else test
    return df.where(~F.coalesce(condition, F.lit(False)))


def difference(given: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the surplus per side."""
    marks = given.select(*expected.columns).withColumn("__n", F.lit(1)).unionByName(expected.withColumn("__n", F.lit(-1)))
    # One aggregate over the union instead of two exceptAll passes.
    return marks.groupBy(*expected.columns).agg(F.sum("__n").alias("surplus")).where("surplus <> 0")


def scd2_integrity(dim: DataFrame, key: str, valid_from: str = "valid_from", valid_to: str = "valid_to", current: str = "is_current") -> DataFrame:
    """Problems of a history: (key, at, problem).

    overlap / gap: a version does not end one second before the next starts;
    reversed: it ends before it starts; current: a key has not exactly one current row.
    """
    shifted = keyed_shift(dim, key, [F.col(valid_from), F.col(valid_to)], {"__next": F.col(valid_from)}, back=False)
    due = F.col("__next") - F.expr("interval 1 second")
    # Two changes within one second leave a version whose end precedes its start by less than that.
    problem = (
        F.when(F.col(valid_to) > due, "overlap").when(F.col(valid_to) < due, "gap")
        .when(F.col(valid_to) < F.col(valid_from) - F.expr("interval 1 second"), "reversed")
    )
    bad = shifted.select(key, F.col(valid_from).alias("at"), problem.alias("problem")).where("problem is not null")
    counts = dim.groupBy(key).agg(F.count_if(F.col(current)).alias("n"), F.max(valid_from).alias("at")).where("n <> 1")
    return bad.unionByName(counts.select(key, "at", F.lit("current").alias("problem")))


def schema_contract(df: DataFrame, declared: T.StructType | str) -> DataFrame:
    """The table itself when names and types are as declared; an error that lists the differences otherwise."""
    want = T.StructType.fromDDL(declared) if isinstance(declared, str) else declared
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    need = {f.name: f.dataType.simpleString() for f in want}
    if have != need:
        wrong = sorted(set(have.items()) ^ set(need.items()))
        raise ValueError(f"schema differs from the contract: {wrong}")
    return df
