"""Plans keep what makes them scale: pushed filters, dropped joins, no pair-wise joins."""

import datetime as dt
import decimal
import hashlib

import __spark_entry__ as entry
import pytest

from granary.functions.hashing import hash_diff, hash_key
from granary.plans import vault as V
from granary.plans.registry import QUERIES


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hub_of_order_columns_reads_one_table(spark, root):
    plan = optimized(V.hub_of(spark, root, "order"))
    assert "Join" not in plan and plan.count("Relation") == 1


def test_satellite_drops_the_joins_it_does_not_read(spark, root):
    assert optimized(V.sat_of(spark, root, "order")).count("Join") == 0
    assert optimized(V.sat_of(spark, root, "customer")).count("Join") == 1


def test_run_date_reaches_the_scan(spark, root):
    plan = physical(entry.queries()["filter_date_var"](spark, root))
    assert "GreaterThanOrEqual(ts,2024-01-15" in plan and "LessThan(ts,2024-01-16" in plan


def test_load_choice_reaches_the_scan(spark, root):
    assert "LessThan(o_orderdate,1998-01-01" in physical(V.hub_of(spark, root, "customer", 1))


def test_only_read_columns_are_scanned(spark, root):
    plan = physical(entry.queries()["agg_latest_per_key"](spark, root))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan


def test_shards_are_pruned(spark, root):
    plan = physical(entry.queries()["src_sharded"](spark, root))
    assert "PartitionFilters: [isnotnull(dt" in plan


@pytest.mark.parametrize("key", ["fct_visits", "scd2_hash_key", "anl_calendar_rollup", "anl_hierarchy_agg", "jaffle_order_items", "join_pairs_below",
                                 "dv_eff_sat", "ga4_fct_access", "anl_time_period"])
def test_no_pairwise_join_and_no_row_copies(spark, root, key):
    plan = physical(entry.queries()[key](spark, root))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if key == "anl_time_period":
        assert "Expand" not in plan


def test_a_total_is_summed_on_the_map_side(spark, root):
    plan = physical(entry.queries()["agg_partial_final"](spark, root))
    assert "partial_sum" in plan and "merge_sum" in plan or plan.count("HashAggregate") >= 2


def test_inventory_feed_reads_the_lines_once(spark, root):
    from granary.plans.vault import raw_inventory

    plan = raw_inventory(spark, root)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and "Aggregate" not in plan


def test_effectivity_of_a_batch_is_made_distinct_once(spark):
    from granary.operators import vault as dv

    rows = spark.range(4).selectExpr("id div 2 as pk", "7L as dfk", "8L as sfk", "date'2020-01-01' as b", "date'9999-12-31' as e",
                                     "date'2020-01-01' as effective_from", "date'2020-01-01' as load_date", "'x' as record_source")
    state = rows.where("pk = 0").withColumn("e", rows.b)
    got = dv.eff_sat(rows, "pk", ["dfk"], "sfk", "b", "e", state=state)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2
    assert sorted((r.pk, str(r.e)) for r in got.collect()) == [(0, "9999-12-31"), (1, "9999-12-31")]


def test_a_stage_with_all_hashes_is_compiled(spark):
    """The JVM only interprets methods beyond 8000 bytes; the hashes must not be fused with the joins into one such method."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = QUERIES["dv_stage_orders"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().debug().codegenToSeq()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert sizes and max(sizes) <= 8000


def test_hashes_of_odd_values(spark):
    """Numbers and times hash as their texts; texts are trimmed and upper-cased; null and empty are marked."""
    kinds = "i long, d date, m decimal(18,2), f double, t timestamp, b boolean, s string"
    odd = [(None,) * 7, (-1, dt.date(1969, 12, 31), decimal.Decimal("0.00"), 1e10, dt.datetime(2024, 1, 2, 3, 4, 5), True, " a b "), (0, None, decimal.Decimal("-1.50"), None, None, False, "  ")]
    df = spark.createDataFrame(odd, kinds)
    got = df.select(hash_key(df, "i").alias("k"), hash_key(df, ["i", "d"]).alias("kd"), hash_key(df, "s").alias("ks"), hash_diff(df, df.columns).alias("all")).collect()
    md5 = lambda text: hashlib.md5(text.encode()).hexdigest()
    assert [tuple(r) for r in got] == [
        (None, None, None, md5("^^||^^||^^||^^||^^||^^||^^")),
        (md5("-1"), md5("-1||1969-12-31"), md5("A B"), md5("TRUE||1969-12-31||10000000000.00||-1||0.00||A B||2024-01-02 03:04:05")),
        (md5("0"), md5("0||^^"), md5("^^"), md5("FALSE||^^||^^||0||-1.50||^^||^^"))]
