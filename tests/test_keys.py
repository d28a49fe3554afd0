"""Declared keys travel with the columns, are checked, and let plans leave out what they promise."""

import pytest

from granary.operators import keys as K
from granary.sources.tables import materialise, table
from tests.conftest import rows


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_declared_key_removes_an_aggregate(spark, root):
    orders = table(spark, root, "orders")
    assert "Aggregate" in plan(K.distinct_rows(orders, ["o_orderkey", "o_custkey"]))
    declared = K.declare_primary(orders, "o_orderkey")
    assert "Aggregate" not in plan(K.distinct_rows(declared, ["o_orderkey", "o_custkey"]))
    assert "Aggregate" in plan(K.distinct_rows(declared, ["o_custkey"]))
    assert rows(K.distinct_rows(declared, ["o_orderkey"])) == rows(K.distinct_rows(orders, ["o_orderkey"]))
    customers = table(spark, root, "customer").withColumnRenamed("c_custkey", "o_custkey")
    plain, short = K.look_up(orders, "o_custkey", customers, ["c_name"]), K.look_up(orders, "o_custkey", K.declare_primary(customers, "o_custkey"), ["c_name"])
    assert "Aggregate" in plan(plain) and "Aggregate" not in plan(short)
    assert rows(plain.select("o_orderkey", "c_name")) == rows(short.select("o_orderkey", "c_name"))


def test_declarations_travel_and_are_dropped(spark):
    df = K.declare_foreign(K.declare_primary(spark.createDataFrame([(1, 2, "x")], "a int, b int, c string"), "a", "b"), "b", "parent", "id")
    stored = materialise(df.where("a > 0"), "keys")
    assert K.primary(stored.select("b", "a")) == ["a", "b"] and K.foreign(stored) == {"b": ("parent", "id")}
    assert K.primary(stored.select("a", "c")) == [] and K.primary(stored.groupBy("a").count()) == []
    assert K.primary(K.undeclared(stored)) == [] and K.foreign(K.undeclared(stored)) == {}


def test_violations(spark):
    df = spark.createDataFrame([(1, 10), (1, 11), (None, 10), (2, None), (3, 99), (4, 99)], "a int, b int")
    df = K.declare_foreign(K.declare_primary(df, "a"), "b", "p", "id")
    parents = {"p": spark.createDataFrame([(10,), (11,)], "id int")}
    assert rows(K.violations(df, parents)) == [("foreign b", '{"b":99}', 2), ("null in primary", '{"a":null}', 1), ("primary", '{"a":1}', 2)]
    with pytest.raises(KeyError):
        K.violations(df)
    assert K.violations(spark.range(3)).count() == 0
