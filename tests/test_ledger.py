"""Registered loads are run once, broken ones do not count, and marts read what loads have stored."""

import pytest
from pyspark.sql import functions as F

from granary.operators import vault as dv
from granary.operators.ledger import Ledger
from granary.plans import vault as V
from granary.sources import adapters as A
from granary.sources.tables import new_path
from tests.conftest import rows


def test_a_load_is_run_once_and_a_broken_one_again(spark):
    ledger, runs = Ledger(spark, new_path(spark, "ledger")), []

    def make(n):
        def rows_of(state):
            runs.append((n, None if state is None else state.count()))
            return spark.range(n, n + 3).select("id", F.lit(n).alias("d"))
        return rows_of

    assert ledger.table("t") is None and ledger.register().count() == 0
    ledger.load("t", 1, make(10), "src", "id")
    ledger.load("t", 1, make(99), "src", "id")
    assert runs == [(10, None)] and ledger.table("t").count() == 3
    with pytest.raises(ZeroDivisionError):
        ledger.load("t", 2, lambda state: 1 / 0)
    spark.range(50).select("id", F.lit(0).alias("d")).write.parquet(ledger._data("t", 2))  # written, never registered
    assert ledger.table("t").count() == 3
    ledger.load("t", 2, make(20), "src", "id")
    again = Ledger(spark, ledger.path)  # a new driver knows it from the folder
    assert rows(again.register()) == [("t", "1", "src", "12", 3), ("t", "2", "src", "22", 3)]
    assert runs[1:] == [(20, 3)] and again.table("t").count() == 6


def test_stored_vault_loads_each_source_once(spark, root, monkeypatch):
    scans = []
    of = V.STAGES[V.ORDERS]
    monkeypatch.setitem(V.STAGES, V.ORDERS, lambda s, r, load=None, only=None: scans.append(load) or of(s, r, load, only))
    vault = V.StoredVault(spark, root)
    for load in (1, 2, 2):
        vault.load(load, **V.ORDER_TABLES)
    assert scans == [1, 2, 2]  # the third call plans the stage and runs nothing
    register = {(r.table, r.load): r.rows for r in vault.ledger.register().collect()}
    assert set(register) == {(t, i) for t in ("stage_orders", "hub_customer", "hub_order", "link_customer_order", "sat_customer", "sat_cust_nation", "sat_order") for i in "12"}
    assert vault["hub_customer"].count() == vault["hub_customer"].select("customer_pk").distinct().count() == V.two_loads(V.hub_of, spark, root, "customer").count()


def test_a_stage_that_reads_no_line_has_a_row_per_order(spark, root):
    """It was stored once per order line."""
    vault = V.StoredVault(spark, root).load(1, **V.ORDER_TABLES)
    assert vault["stage_orders"].count() == A.vault_orders(spark, root, 1).count()


def test_links_by_their_natural_keys(spark):
    """The same links as by their hashes, over null keys, repeats and stored links; and hashes of other keys are not shuffled."""
    hashed = {"ab_pk": ["a", "b"], "a_pk": ["a"], "b_pk": ["b"]}
    values = [(1, 2, "2020-01-02", "x"), (1, 2, "2020-01-02", "w"), (1, 2, "2020-01-01", "y"), (1, None, "2020-01-01", "x"), (None, None, "2020-01-01", "x"), (3, 2, "2020-01-01", "x"), (12, 3, "2020-01-01", "x")]
    batch = spark.createDataFrame(values, "a long, b int, load_date string, record_source string").withColumn("load_date", F.to_date("load_date"))
    staged = dv.stage(batch, {}, hashed)
    for state in (None, dv.link(staged.where("a = 3"), "ab_pk", ["a_pk", "b_pk"])):
        by_keys = dv.link(staged, "ab_pk", ["a_pk", "b_pk"], state=state, hashed=hashed)
        assert rows(by_keys) == rows(dv.link(staged, "ab_pk", ["a_pk", "b_pk"], state=state)) and by_keys.count() == (2 if state else 3)
        plan = by_keys._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("AS a_pk") < plan.index("Aggregate")  # hashed above the aggregate
    texts = dv.stage(batch.withColumn("a", F.when(F.col("a") == 1, F.concat(F.col("record_source"), F.lit(" "))).otherwise("W")), {}, hashed)
    assert rows(dv.link(texts, "ab_pk", ["a_pk", "b_pk"], hashed=hashed)) == rows(dv.link(texts, "ab_pk", ["a_pk", "b_pk"]))
