"""Histories with late rows, and as-of joins, against one load and a plain range join."""

import datetime as dt
import random

from pyspark.sql import functions as F

from granary.operators import quality, scd
from granary.operators.joins import asof_join
from granary.sources.tables import cut_lineage
from tests.conftest import rows as table


def test_late_rows_in_any_order_give_the_history_of_one_load(spark):
    """Random batches, null keys and ties in time; keys of versions that stay are kept."""
    rng = random.Random(12)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice("abc"), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(300))) for _ in range(160)]
    schema = "k int, a string, ts timestamp_ntz"
    once = scd.scd2(spark.createDataFrame(rows, schema), "k", ["a"], "ts")
    seen, state, ints, keys = [], None, None, {}
    for i in range(0, 160, 40):
        seen += rows[i:i + 40]
        batch, source = spark.createDataFrame(rows[i:i + 40], schema), spark.createDataFrame(seen, schema)
        state = cut_lineage(scd.scd2_recut(state, batch, "k", ["a"], "ts", source))
        ints = cut_lineage(scd.scd2_recut(ints, batch, "k", ["a"], "ts", source, sk="int"))
        now = {(r.k, r.valid_from): r.user_sk for r in ints.collect()}
        assert len(set(now.values())) == len(now) and all(keys[v] == now[v] for v in keys.keys() & now.keys())
        keys = now
    shown = ["user_sk", "k", "a", "hash_value", "valid_from", F.col("valid_to").cast("string"), "is_current"]
    assert table(state.select(*shown)) == table(once.select(*shown))
    assert table(ints.select(*shown[1:])) == table(once.select(*shown[1:]))
    assert quality.scd2_integrity(state, "k").count() == 0


def test_late_row_without_its_source(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    schema = "k int, a string, ts timestamp_ntz"
    state = scd.scd2(spark.createDataFrame([(1, "a", at(1)), (1, "b", at(10)), (2, "c", at(3))], schema), "k", ["a"], "ts")
    out = scd.scd2_recut(state, spark.createDataFrame([(1, "z", at(5))], schema), "k", ["a"], "ts")
    got = sorted((r.k, r.a, r.valid_from, r.t[:19]) for r in out.select("*", F.col("valid_to").cast("string").alias("t")).collect())
    assert got == [(1, "a", at(1), "2024-01-04 23:59:59"), (1, "b", at(10), "9999-12-31 00:00:00"), (1, "z", at(5), "2024-01-09 23:59:59"),
                   (2, "c", at(3), "9999-12-31 00:00:00")]
    assert quality.scd2_integrity(out, "k").count() == 0


def test_asof_carries_versions_over_partition_edges(spark):
    """A hot key and null keys and times, against a plain range join, with enough partitions that every key is cut."""
    rng = random.Random(6)
    dim = [(k, at, at + 9 if i < 20 else 10**6, f"{k}-{at}") for k in (1, 2, 3) for i, at in enumerate(range(5, 215, 10))] + [(None, 0, 99, "null")]
    facts = [(rng.choice([1, 1, 1, 1, 2, 3, 4, None]), rng.choice([None, *range(230)]), i) for i in range(600)]
    d, f = spark.createDataFrame(dim, "k int, f long, t long, v string"), spark.createDataFrame(facts, "k int, ts long, id int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for closed in (True, False):
            for how in ("left", "inner"):
                got = table(asof_join(f, d, "k", "k", "ts", "f", "t", ["v"], how=how, closed=closed))
                end = F.col("ts") <= F.col("t") if closed else F.col("ts") < F.col("t")
                plain = f.join(d.withColumnRenamed("k", "dk"), (F.col("k") == F.col("dk")) & (F.col("ts") >= F.col("f")) & end, how).select("k", "ts", "id", "v")
                assert got == table(plain)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
