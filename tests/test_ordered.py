"""The range-partitioned helpers against plain Python and plain windows, with one hot key and null keys."""

import random
from itertools import groupby

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.operators import ordered as O
from granary.operators import stats as S


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        key = 0 if rng.random() < 0.4 else rng.choice([None, *range(1, 30)])
        rows.append((key, rng.randrange(200), i, rng.choice([None, 1, 2, 5])))
    return rows, spark.createDataFrame(rows, "k int, t int, id int, v int").repartition(5)


def by_key(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return {k: list(g) for k, g in groupby(rows, key=lambda r: r[0])}


ORDER = lambda: [F.col("t"), F.col("id")]


@pytest.mark.parametrize("back", [True, False])
def test_shift(data, back):
    rows, df = data
    got = {r.id: r.near for r in O.keyed_shift(df, "k", ORDER(), {"near": F.col("id")}, back=back).collect()}
    want = {}
    for group in by_key(rows).values():
        ids = [r[2] for r in group]
        for i, x in enumerate(ids):
            j = i - 1 if back else i + 1
            want[x] = ids[j] if 0 <= j < len(ids) else None
    assert got == want


def test_running_and_row_number(data):
    rows, df = data
    got = {r.id: (r.s, r.n) for r in O.keyed_running(df, "k", ORDER(), {"s": F.coalesce("v", F.lit(0)), "n": F.lit(1)}).collect()}
    for group in by_key(rows).values():
        total = 0
        for i, r in enumerate(group):
            total += r[3] or 0
            assert got[r[2]] == (total, i + 1)


@pytest.mark.parametrize("parts", [2, 13, 60])
def test_every_helper_equals_a_plain_window(spark, data, parts):
    """Null keys, null values, two key columns, and keys cut by many partition edges."""
    _, df = data
    df = df.withColumn("g", F.when(F.col("k") == 0, F.lit(None).cast("int")).otherwise(F.col("k") % 2))
    w = W.partitionBy("k", "g").orderBy("t", "id")
    up_to, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    want = df.select("id", F.sum("v").over(up_to).alias("s"), F.min("v").over(up_to).alias("lo"), F.max("v").over(ahead).alias("hi"),
                     F.last("v", ignorenulls=True).over(ahead).alias("held"), F.row_number().over(w).alias("n"), F.lag("v").over(w).alias("back"),
                     F.lead("id").over(w).alias("on"), F.dense_rank().over(W.partitionBy("k", "g").orderBy("v")).alias("d")).orderBy("id").collect()
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        keys = ["k", "g"]
        out = O.keyed_fold(df, keys, ORDER(), {"s": ("sum", F.col("v")), "lo": ("min", F.col("v"))})
        out = O.keyed_fold(out, keys, ORDER(), {"hi": ("max", F.col("v")), "held": ("last", F.col("v"))}, before=True)
        out = O.keyed_row_number(out, keys, ORDER(), "n")
        out = O.keyed_shift(out, keys, ORDER(), {"back": F.col("v")})
        out = O.keyed_shift(out, keys, ORDER(), {"on": F.col("id")}, back=False)
        out = O.keyed_dense_rank(out, keys, "v", "d")
        assert out.select("id", "s", "lo", "hi", "held", "n", "back", "on", "d").orderBy("id").collect() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_a_hot_key_in_one_day_is_spread(spark):
    """90 % of the rows are one key at one time: every range still gets its share, and the numbers are right."""
    rows = spark.range(20_000).selectExpr("if(id % 10 = 0, id, 7) as k", "if(id % 10 = 0, id, 5) as t", "id")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = O._ranged(rows, ["k"], [F.col("t")], "test")
        sizes = [r["count"] for r in placed.groupBy(O._PART).count().collect()]
        assert len(sizes) == 16 and max(sizes) < 2 * 20_000 / 16
        numbers = O.keyed_row_number(rows, "k", [F.col("t")], "n").where("k = 7").agg(F.count("*"), F.countDistinct("n"), F.min("n"), F.max("n")).first()
        assert tuple(numbers) == (18_000, 18_000, 1, 18_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_global_numbers(data):
    rows, df = data
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    got = {r.id: r.n for r in O.global_row_number(df, ORDER(), "n", start=10).collect()}
    assert got == {r[2]: 11 + i for i, r in enumerate(order)}
    times = sorted({r[1] for r in rows})
    dense = {r.id: r.n for r in O.global_dense_rank(df, ["t"], "n").collect()}
    assert dense == {r[2]: times.index(r[1]) + 1 for r in rows}
    rank = {r.id: r.n for r in O.global_rank(df, ["t"], "n").collect()}
    assert rank == {r[2]: 1 + sum(x[1] < r[1] for x in rows) for r in rows}


def test_keyed_prefix_sum(data):
    rows, df = data
    got = {r.id: r.before for r in O.global_prefix_sum(df, ORDER(), {"before": F.lit(1)}, key=["k"]).collect()}
    for group in by_key(rows).values():
        for i, r in enumerate(group):
            assert got[r[2]] == i


def test_latest_and_qualify(data, spark):
    rows, df = data
    got = {r.k: r.id for r in O.latest_per_key(df, "k", ORDER()).collect()}
    assert got == {k: g[-1][2] for k, g in by_key(rows).items()}
    small = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    assert O.qualify(small, {"x": F.col("b") * 2}, "x > 4").collect() == [(1, 3)]


def test_intervals(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(1, 6), s, s + rng.randrange(1, 60)) for s in (rng.randrange(1000) for _ in range(400))]
    df = spark.createDataFrame(rows, "k int, s long, e long")
    want = {}
    for k in {r[0] for r in rows}:
        last, n = -1, 0
        for e, s in sorted((e, s) for kk, s, e in rows if kk == k):
            if s >= last:
                last, n = e, n + 1
        want[k] = n
    assert {r.k: r.n_chosen for r in S.interval_schedule(df, "k", "s", "e").collect()} == want
    # Null keys are a key; intervals without length all count; reversed and null ones do not.
    odd = [(None, 0, 5), (None, 5, 9), (None, 4, 6), (1, 3, 3), (1, 3, 3), (1, 2, 4), (1, 3, 8), (1, 8, 8), (2, 5, 1), (3, None, 4), (4, -7, -7)]
    got = {r.k: r.n_chosen for r in S.interval_schedule(spark.createDataFrame(odd, "k int, s long, e long"), "k", "s", "e").collect()}
    assert got == {None: 2, 1: 4, 4: 1}
    assert S.interval_schedule(spark.createDataFrame([], "k int, s long, e long"), "k", "s", "e").count() == 0


def test_long_schedule_takes_few_rounds(spark):
    """A thousand intervals in a row, one key."""
    row = spark.range(1000).selectExpr("cast(null as int) as k", "id * 10 as s", "id * 10 + 10 as e")
    assert S.interval_schedule(row, "k", "s", "e").collect() == [(None, 1000)]


def test_closest_pair(spark):
    rng = random.Random(5)
    points = [(rng.random() * 10, rng.random()) for _ in range(150)] + [(3 + rng.random() * 1e-3, 0.5 + rng.random() * 1e-3) for _ in range(100)]
    want = min(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for i, a in enumerate(points) for b in points[:i])
    got = S.closest_pair(spark.createDataFrame(points, "x double, y double"), F.col("x"), F.col("y")).first()[0]
    assert got == pytest.approx(want, rel=1e-12)
    twice = spark.createDataFrame(points + points[:1], "x double, y double")
    assert S.closest_pair(twice, F.col("x"), F.col("y")).first()[0] == 0.0
    assert S.closest_pair(spark.createDataFrame([(1.0, 2.0)], "x double, y double"), F.col("x"), F.col("y")).first()[0] is None


def test_greedy_fill(spark):
    df = spark.createDataFrame([(1, 10, 6), (1, 15, 3), (1, 5, 2)], "k int, price int, qty long").withColumn("price", F.col("price").cast("decimal(18,2)"))
    got = S.greedy_fill(df, "k", "price", "qty", 6, [F.col("price")]).first()
    assert (got.units, float(got.cost)) == (6, 50.0)


def test_deadlines(spark):
    df = spark.createDataFrame([(1, 3, 5), (1, 2, 3), (2, 4, 5), (2, 2, 5)], "k int, w long, d long")
    got = {r.k: r.feasible for r in S.deadlines_met(df, "k", "w", "d", [F.col("d"), F.col("w")]).collect()}
    assert got == {1: True, 2: False}


def test_mean_median_mode(spark):
    df = spark.createDataFrame([("a", x) for x in (3, 1, 2, 2, 9, 9)], "k string, v long")
    assert S.mean_median_mode(df, "k", F.col("v")).collect() == [("a", 4, 3, 2)]
    mixed = spark.createDataFrame([(None, 4), (None, 6), ("a", 1)], "k string, v long")
    assert sorted(S.mean_median_mode(mixed, "k", F.col("v")).collect(), key=str) == [("a", 1, 1, 1), (None, 5, 6, 4)]
