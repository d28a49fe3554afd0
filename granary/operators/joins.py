"""Joins beyond a plain equi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.ordered import keyed_fold


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other."""
    other = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(other, test, how).drop(*[f"__r_{k}" for k in keys])


def asof_join(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, ts: str, valid_from: str, valid_to: str,
              columns: Sequence[str], how: str = "left", closed: bool = True) -> DataFrame:
    """Attach to each fact the dimension version whose validity holds its timestamp.

    Facts and versions are sorted together by (key, time) into range partitions, and the
    last version started is carried forward over the facts, also across partition edges.
    So nothing is copied, the facts are read once, and a key may have any share of either
    side. Versions of one key must not overlap, which `scd2_integrity` checks. `closed`
    keeps BETWEEN semantics; otherwise the end is exclusive. A null key or time finds nothing.
    """
    version = F.struct(F.col(valid_to).alias("__to"), *[F.col(c) for c in columns])
    started = dim.where(F.col(dim_key).isNotNull() & F.col(valid_from).isNotNull()).select(
        F.col(dim_key).alias("__key"), F.col(valid_from).alias("__at"), version.alias("__version"))
    asked = fact.select(F.col(fact_key).alias("__key"), F.col(ts).alias("__at"), F.struct(*[F.col(c) for c in fact.columns]).alias("__fact"))
    both = started.unionByName(asked, allowMissingColumns=True)
    # At one time a version comes before the facts.
    order = [F.col("__at"), F.col("__fact").isNotNull()]
    held = keyed_fold(both, "__key", order, {"__found": ("last", F.col("__version"))}).where("__fact is not null")
    upper = F.col("__at") <= F.col("__found.__to") if closed else F.col("__at") < F.col("__found.__to")
    inside = F.when(F.col("__key").isNotNull() & upper, F.col("__found"))
    out = held.withColumn("__found", inside)
    if how == "inner":
        out = out.where("__found is not null")
    elif how != "left":
        raise ValueError(f"an as-of join is left or inner, not {how!r}")
    return out.select("__fact.*", *[F.col("__found")[c].alias(c) for c in columns])


def explore(base: DataFrame, joins: Sequence[tuple[DataFrame, Column, str]], dimensions: dict[str, Column],
            measures: dict[str, Column]) -> DataFrame:
    """Semantic-layer query: base plus joins, grouped by dimensions, with measures."""
    df = base
    for other, test, how in joins:
        df = df.join(other, test, how)
    return df.groupBy(*[c.alias(n) for n, c in dimensions.items()]).agg(*[c.alias(n) for n, c in measures.items()])
