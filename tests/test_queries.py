"""Registered queries against their SQL. GRANARY_ALL=1 runs every one of them."""

import os

import pytest

import __spark_entry__ as entry
from granary.plans import registry
from tests.oracle import compare, connect

SAMPLE = [
    "dv_hub_nation", "dv_link_customer_order", "dv_sat_customer", "dv_eff_sat", "dv_ma_sat", "dv_info_customer_order", "scd2_hash_key_incremental",
    "scd2_late_correction", "fct_visits", "dim_calendar", "dim_time", "fct_game_schedule", "anl_calendar_rollup", "anl_hierarchy_agg", "fct_session_summary",
    "fct_user_ltv", "jaffle_orders", "src_csv_dirty", "sink_insert_overwrite", "join_pairs_below", "win_interval_schedule", "agg_median_mode_mean",
    "stream_daily_access", "graph_components", "log_topics_scan",
]


@pytest.fixture(scope="module")
def duck(root):
    return connect(root)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE)
    assert set(SAMPLE) <= set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("key", sorted(registry.QUERIES) if os.environ.get("GRANARY_ALL") else SAMPLE)
def test_query(spark, root, duck, key):
    assert compare(entry.queries()[key](spark, root), duck, entry.oracle_sql()[key]) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["orderdate", "customer_nation_name", "orderstatus", "sum_totalprice"]
