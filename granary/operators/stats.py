"""Order statistics and greedy schedules that do not gather a group in one place."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.joins import null_safe_join
from granary.operators.ordered import global_prefix_sum, keyed_fold, keyed_running
from granary.sources.tables import cut_lineage, materialise


def mean_median_mode(df: DataFrame, key: str, value: Column) -> DataFrame:
    """Whole-number mean, upper median and smallest most frequent value per key.

    Works on (key, value, count): repeated values are combined before the shuffle, and
    the position of a value is a prefix sum of counts.
    """
    counts = df.groupBy(key, value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed = global_prefix_sum(counts, [F.col("v")], {"below": F.col("n")}, key=[key])
    totals = counts.groupBy(key).agg(
        F.sum("n").alias("total"), F.sum(F.col("n") * F.col("v")).alias("sum"),
        F.max_by("v", F.struct(F.col("n"), (-F.col("v")).alias("small"))).alias("mode"))
    middle = F.expr("total div 2")
    hit = null_safe_join(placed, totals, [key]).where((F.col("below") <= middle) & (middle < F.col("below") + F.col("n")))
    return hit.select(key, F.expr("sum div total").alias("mean"), F.col("v").alias("median"), "mode")


def spread_and_second(df: DataFrame, key: str, value: Column) -> DataFrame:
    """Range, and the second smallest value with ties counted once and counted each.

    Two aggregates: the smallest value and how often, then the smallest above it.
    """
    rows = df.select(key, value.alias("v"))
    lo = rows.groupBy(key, "v").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(
        F.min(F.struct("v", "n")).alias("m"), F.max("v").alias("hi"))
    lo = lo.select(key, F.col("m.v").alias("lo"), F.col("m.n").alias("n_lo"), "hi")
    above = rows.join(lo.select(key, "lo"), key).where(F.col("v") > F.col("lo")).groupBy(key).agg(F.min("v").alias("second_distinct"))
    out = lo.join(above, key, "left")
    second = F.when(F.col("n_lo") > 1, F.col("lo")).otherwise(F.col("second_distinct"))
    return out.select(key, (F.col("hi") - F.col("lo")).alias("spread"), second.alias("second_smallest"), "second_distinct")


def greedy_fill(df: DataFrame, key: str, price: str, quantity: str, need: int, order: Sequence[Column]) -> DataFrame:
    """Cost of buying `need` units cheapest first, per key; and how many could be bought."""
    rows = keyed_running(df, key, order, {"upto": F.col(quantity)})
    taken = F.greatest(F.lit(0), F.least(F.col(quantity), F.lit(need) - (F.col("upto") - F.col(quantity))))
    rows = rows.withColumn("taken", taken.cast("bigint"))
    return rows.groupBy(key).agg(
        F.sum("taken").alias("units"), F.sum(F.col(price) * F.col("taken").cast("decimal(18,0)")).cast("decimal(38,2)").alias("cost"))


def deadlines_met(df: DataFrame, key: str, work: str, deadline: str, order: Sequence[Column]) -> DataFrame:
    """Per key: can all jobs meet their deadline when done earliest deadline first?"""
    rows = keyed_running(df, key, order, {"done": F.col(work)})
    return rows.groupBy(key).agg(F.bool_and(F.col("done") <= F.col(deadline)).alias("feasible"), F.sum(work).alias("total_work"))


def interval_schedule(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, n_chosen): largest number of non-overlapping intervals per key (earliest end first); intervals may touch.

    Being free from time t on leads to the earliest end among the intervals that start at t
    or later: one pointer per distinct end, found by a running minimum from the latest start
    down. Pointers are then doubled, so the longest schedule takes logarithmically many
    rounds, and no key is ever gathered. An interval without length is always chosen, and
    each of them counts. Whole-number times; intervals with a null end or start, or that end
    before they start, are left out.
    """
    floor = -(1 << 62)
    one = F.struct(F.lit(0).alias("g"), F.col(key).alias("k")).alias("k")  # equal to itself also where the key is null
    ivs = df.select(one, F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e")).where("s <= e")
    ivs = ivs.groupBy("k", "s", "e").agg(F.count(F.lit(1)).alias("n"))
    points = ivs.groupBy("k", "e").agg(F.sum(F.when(F.col("s") == F.col("e"), F.col("n")).otherwise(0)).alias("n_points"))
    # From the latest time down: at one time intervals that start there, then the question, then points (a point needs a later time).
    where_free = points.select("k", F.col("e").alias("t")).unionByName(ivs.select("k").distinct().withColumn("t", F.lit(floor).cast("bigint")))
    offers = ivs.select("k", F.col("s").alias("t"), F.struct(F.col("e"), (F.col("s") == F.col("e")).alias("is_point")).alias("offer"))
    both = offers.unionByName(where_free, allowMissingColumns=True)
    turn = F.when(F.col("offer").isNull(), 1).when(F.col("offer.is_point"), 2).otherwise(0)
    found = keyed_fold(both, "k", [F.desc("t"), turn], {"best": ("min", F.col("offer"))}).where("offer is null")
    steps = found.select("k", "t", F.col("best.e").alias("next"), (~F.col("best.is_point")).cast("bigint").alias("own"))
    there = points.select("k", F.col("e").alias("next"), "n_points")
    at = steps.join(there, ["k", "next"], "left").select(
        "k", "t", "next", F.when(F.col("next").isNull(), 0).otherwise(F.col("own") + F.col("n_points")).cast("bigint").alias("n"))
    at = materialise(at, "schedule")
    while not at.where(F.col("next").isNotNull() & (F.col("t") == floor)).isEmpty():
        ahead = at.select("k", F.col("t").alias("next"), F.col("next").alias("after"), F.col("n").alias("more"))
        doubled = at.join(ahead, ["k", "next"], "left").select("k", "t", F.col("after").alias("next"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
        at = materialise(doubled, "schedule")
    return at.where(F.col("t") == floor).select(F.col("k.k").alias(key), F.col("n").alias("n_chosen"))


def closest_pair(points: DataFrame, x: Column, y: Column) -> DataFrame:
    """Smallest distance between two points of the plane, without comparing all pairs.

    Points go into square cells. If some cell holds m points, two of them share one of
    its k x k parts with k = floor(sqrt(m - 1)), so the answer is at most side*sqrt(2)/k.
    That bound becomes the next side, until no cell holds more than four points. The
    answer is then within one cell or between neighbours, a small equi-join.
    """
    spots = cut_lineage(points.select(x.cast("double").alias("x"), y.cast("double").alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    box = spots.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"),
                    F.max("n").alias("copies"), F.count(F.lit(1)).alias("spots")).first()
    spark = points.sparkSession
    if box.spots == 0 or (box.spots == 1 and box.copies == 1):
        return spark.range(1).select(F.lit(None).cast("double").alias("min_distance"))
    if box.copies > 1:
        return spark.range(1).select(F.lit(0.0).alias("min_distance"))
    side = max(box.x1 - box.x0, box.y1 - box.y0) * (1 + 1e-9)

    def cells(width: float) -> DataFrame:
        return spots.withColumns({
            "cx": F.floor((F.col("x") - box.x0) / F.lit(width)), "cy": F.floor((F.col("y") - box.y0) / F.lit(width))})

    while True:
        most = cells(side).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0]
        k = math.isqrt(most - 1)
        if k < 2:
            break
        side = side * math.sqrt(2) / k * (1 + 1e-9)
    here = cells(side)
    around = F.sequence(F.lit(-1), F.lit(1))
    near = (
        here.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
        .select((F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    )
    later = (F.col("x") < F.col("x2")) | ((F.col("x") == F.col("x2")) & (F.col("y") < F.col("y2")))
    gap = F.sqrt((F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2")))
    return here.join(near, ["cx", "cy"]).where(later).agg(F.min(gap).alias("min_distance"))
