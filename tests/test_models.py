"""Marts, texts, loads and histories on small given rows."""

import datetime as dt
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from granary.functions.values import first_failure, param
from granary.operators import quality, scd, text
from granary.operators import vault as dv
from granary.operators.joins import asof_join, null_safe_join
from granary.plans import games, modelling, shop
from granary.plans import vault as vault_plans
from granary.plans.aggregates import array_avg, words
from granary.plans.predicates import find_value, lookup, on_day, search
from granary.plans.registry import QUERIES
from granary.plans.scalars import sum_numbers
from granary.sources import sinks
from granary.sources.tables import date_spine, new_path, read_dirty_csv, read_shards, read_text_lines, table
from tests.conftest import rows

D = dt.date
T = lambda d, h=0: dt.datetime(2024, 1, d, h)


# --- shop marts -----------------------------------------------------------------------


def test_supply_costs_sum(spark):
    supplies = spark.createDataFrame([(1, 4.50), (2, 3.50), (2, 5.00)], "product_id int, supply_cost double").withColumn("supply_cost", F.col("supply_cost").cast("decimal(16,2)"))
    products = spark.createDataFrame([(1, "p", True, False), (2, "q", False, True)], "product_id int, product_name string, is_food_item boolean, is_drink_item boolean").withColumn("product_price", F.lit(1).cast("decimal(16,2)"))
    items = spark.createDataFrame([("1", 1, 1), ("2", 2, 2), ("3", 2, 2)], "order_item_id string, order_id int, product_id int")
    orders = spark.createDataFrame([(1,), (2,)], "order_id int").withColumn("order_date", F.to_date(F.lit("2024-01-01")))
    got = shop.order_items(items, orders, products, supplies)
    assert [float(r.supply_cost) for r in got.orderBy("order_item_id").collect()] == [4.5, 8.5, 8.5]
    flags = {r.order_id: (r.is_food_order, r.is_drink_order) for r in shop.order_mart(orders.withColumn("customer_id", F.lit(1)), got).collect()}
    assert flags == {1: (True, False), 2: (False, True)}


def test_opened_date(spark):
    df = spark.createDataFrame([(1, "a", 0.1, "2016-09-01T00:00:00"), (2, "b", 0.1, "2079-10-27T23:59:59.9999")], "id int, name string, tax_rate double, opened_at string")
    assert [r.opened_date for r in shop.stg_locations(df).orderBy("location_id").collect()] == [D(2016, 9, 1), D(2079, 10, 27)]


# --- texts ----------------------------------------------------------------------------


def test_checklist_and_rescan(spark):
    files = spark.createDataFrame([("a.md", "- [x] t1\n- [ ] t2\n- [x] t3\n## header\n")], "file_path string, content string")
    found = text.topics(files)
    assert rows(found) == [("t1", "a.md", True), ("t2", "a.md", False), ("t3", "a.md", True)]
    assert sinks.upsert(found, text.topics(files), "name").count() == 3


def test_session_title(spark):
    files = spark.createDataFrame([("a.md", "# Rust 学習ログ: 2026-05-31\nbody"), ("b.md", "no date"), ("c.md", "")], "file_path string, content string")
    got = {r.file_path: (r.title, r.date) for r in text.sessions(files).collect()}
    assert got == {"a.md": ("Rust 学習ログ: 2026-05-31", "2026-05-31"), "b.md": ("no date", "unknown"), "c.md": ("unknown", "unknown")}
    s = text.summary(text.sessions(files), text.topics(files)).first()
    assert (s.total_sessions, s.total_topics, s.completed_topics) == (3, 0, 0)


def test_grep(spark):
    df = spark.createDataFrame([(1, "Harvest notes\nbarley, oats and rye\nnothing milled\nnew HARVEST due")], "id int, body string")
    assert [(r.line_no, r.line) for r in text.grep(df, "body", "oats").collect()] == [(2, "barley, oats and rye")]
    assert [r.line_no for r in text.grep(df, "body", "hArVeSt", ignore_case=True).collect()] == [1, 4]


def test_text_files_by_extension(spark, tmp_path):
    (tmp_path / "a.md").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("no")
    got = read_text_lines(spark, str(tmp_path), "*.md").collect()
    assert [r.content for r in got] == ["one\ntwo"]


def test_words_and_averages(spark):
    df = spark.createDataFrame([("  Hello      world   ",), ("a\tb\nc",), ("",)], "t string")
    assert words(df, "t").groupBy("t").count().orderBy("t").select("count").collect() == [(2,), (3,)]
    arrays = spark.createDataFrame([([10, 0],), ([],)], "a array<bigint>")
    assert [r[0] for r in arrays.select(array_avg("a")).collect()] == [5, None]


def test_rules(spark):
    df = spark.createDataFrame([("Ab1",), ("abcdefg1",), ("ABCDEFG1",), ("Abcdefgh",), ("Abcdefg1",)], "p string")
    assert [r[0] for r in df.select(first_failure(F.col("p"))).collect()] == ["too_short", "no_uppercase", "no_lowercase", "no_digit", None]


def test_number_sum(spark):
    df = spark.createDataFrame([("3",), ("-4",), ("x",), ("4.5",)], "w string")
    got = sum_numbers(df, F.col("w")).first()
    assert (int(got.total), got.rejected) == (-1, 2)


def test_optional_filters(spark):
    df = spark.createDataFrame([(1, "2026-05-31", "Rust"), (2, "2026-06-01", "SQL")], "id int, date string, content string")
    assert search(df, "content").count() == 2
    assert search(df, "content", keyword="Rust").count() == search(df, "content", equals={"date": "2026-06-01"}).count() == 1
    assert lookup(df, "id", 9).count() == 0
    assert tuple(find_value(df, F.col("id") == 2, F.col("id")).first()) == (True, 2, 1)
    assert tuple(find_value(df.limit(0), F.col("id") == 2, F.col("id")).first()) == (False, None, 0)
    days = spark.createDataFrame([(T(1, 5),), (T(2),)], "ts timestamp_ntz")
    assert (on_day(days, "ts", "2024-01-01").count(), on_day(days, "ts", None).count()) == (1, 2)


def test_param_lookup(spark):
    df = spark.sql("select array(named_struct('key','a','value',named_struct('int_value',5))) as p")
    assert tuple(df.select(param("p", "a", "int_value"), param("p", "b", "int_value")).first()) == (5, None)


# --- vault ----------------------------------------------------------------------------


def staged(spark, given, day):
    df = spark.createDataFrame(given, "k long, name string, phone string")
    return dv.stage(df, {"record_source": "!src", "effective_from": F.to_date(F.lit(day))}, {"pk": ["k"], "pair_pk": ["k", "name"], "hd": dv.HashDiff(("k", "name"))}, day)


FIRST = [(1, "a", "p1"), (1, "a", "p2"), (2, "b", "p3"), (None, "z", "p4")]


def test_reload_adds_nothing(spark):
    batch = staged(spark, FIRST, "2024-01-01")
    loads = {
        "hub": lambda s: dv.hub(batch, "pk", "k", state=s), "link": lambda s: dv.link(batch, "pair_pk", ["pk"], state=s),
        "t_link": lambda s: dv.t_link(batch, "pair_pk", ["pk"], ["name"], state=s), "sat": lambda s: dv.sat(batch, "pk", "hd", ["name"], state=s),
        "ma_sat": lambda s: dv.ma_sat(batch, "pk", ["phone"], ["name"], "hd", state=s), "xts": lambda s: dv.xts(batch, "pk", {"s": "hd"}, state=s),
    }
    sizes = {n: load(None).count() for n, load in loads.items()}
    assert sizes == {"hub": 2, "link": 2, "t_link": 2, "sat": 2, "ma_sat": 3, "xts": 2}
    for load in loads.values():
        assert load(load(None)).count() == 0


def test_sat_there_and_back(spark):
    table = None
    for i, name in enumerate(["a", "b", "b", "a"]):
        table = dv.append(table, dv.sat(staged(spark, [(1, name, "p")], f"2024-01-0{i + 1}"), "pk", "hd", ["name"], state=table))
    assert [(r.load_date.day, r.name) for r in table.orderBy("load_date").collect()] == [(1, "a"), (2, "b"), (4, "a")]
    assert dv.current_sat(table, "pk", "hd").first().name == "a"


def test_multi_active_set_changes(spark):
    first = dv.ma_sat(staged(spark, FIRST, "2024-01-01"), "pk", ["phone"], ["name"], "hd")
    fewer = dv.ma_sat(staged(spark, [(1, "a", "p1"), (2, "b", "p3")], "2024-01-02"), "pk", ["phone"], ["name"], "hd", state=first)
    assert [r.phone for r in fewer.collect()] == ["p1"]


def test_first_load_wins(spark):
    early, late = staged(spark, [(1, "a", "p")], "2024-01-01"), staged(spark, [(1, "a", "p"), (2, "b", "p")], "2024-01-02")
    got = {r.k: r.load_date.day for r in dv.hub([late, early], "pk", "k").collect()}
    assert got == {1: 1, 2: 2}


# --- histories ------------------------------------------------------------------------

SEEN = [("u", "A", T(1)), ("u", "A", T(2)), ("u", "B", T(3)), ("u", "A", T(4)), ("w", "C", T(2))]


def seen(spark, given=SEEN):
    return spark.createDataFrame(given, "user string, v string, ts timestamp_ntz")


def test_history_there_and_back(spark):
    got = scd.scd2(seen(spark), "user", ["v"], "ts")
    flat = [(r.user, r.v, r.valid_from.day, r.is_current) for r in got.orderBy("user", "valid_from").collect()]
    assert flat == [("u", "A", 1, False), ("u", "B", 3, False), ("u", "A", 4, True), ("w", "C", 2, True)]
    assert got.where("user = 'u' and v = 'B'").first().valid_to == dt.datetime(2024, 1, 3, 23, 59, 59)
    assert quality.scd2_integrity(got, "user").count() == 0


@pytest.mark.parametrize("sk", ["md5", "int"])
def test_history_by_runs_equals_one_run(spark, sk):
    df = seen(spark)
    step = lambda state, batch: scd.scd2_merge(state, scd.scd2(batch, "user", ["v"], "ts", state=state, sk=sk))
    parts = [df.where(F.dayofmonth("ts") == d) for d in (1, 2, 3, 4)]
    cols = ["user", "v", "valid_from", "valid_to", "is_current"]
    by_runs = scd.backfill(step, parts)
    assert rows(by_runs.select(*cols)) == rows(scd.scd2(df, "user", ["v"], "ts").select(*cols))
    assert by_runs.select("user_sk").distinct().count() == 4


def test_correction(spark):
    state = scd.scd2_first_seen(seen(spark, [("u", "A", T(1)), ("u", "X", T(5)), ("u", "C", T(9))]), "user", ["v"], "ts")
    merged = scd.scd2_merge(state, scd.scd2_correct(state, seen(spark, [("u", "B", T(5)), ("u", "L", T(3))]), "user", ["v"], "ts", "2024-01-02"), "customer_sk")
    assert [(r.v, r.valid_from.day) for r in merged.orderBy("valid_from").collect()] == [("A", 1), ("L", 3), ("B", 5), ("C", 9)]
    assert quality.scd2_integrity(merged, "user").count() == 0
    assert merged.select("customer_sk").distinct().count() == 4


def test_snapshots(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    two = spark.createDataFrame([(1, None), (2, "b"), (3, "c")], "k int, v string")
    s1 = scd.snapshot(one, "k", ["v"], "2024-01-01 00:00:00")
    s2 = scd.snapshot(two, "k", ["v"], "2024-01-02 00:00:00", state=s1)
    got = {(r.k, r.v): (r.valid_from.day, r.valid_to and r.valid_to.day) for r in s2.collect()}
    assert got == {(1, "a"): (1, 2), (1, None): (2, None), (2, "b"): (1, None), (3, "c"): (2, None)}


def test_asof_edges(spark):
    dim = spark.createDataFrame([("u", 1, T(1), dt.datetime(2024, 1, 1, 23, 59, 59)), ("u", 2, T(2), dt.datetime(9999, 12, 31))], "k string, sk int, f timestamp_ntz, t timestamp_ntz")
    fact = spark.createDataFrame([("u", T(1)), ("u", dt.datetime(2024, 1, 1, 23, 59, 59, 500000)), ("u", dt.datetime(2024, 3, 9)), ("x", T(1))], "k string, ts timestamp_ntz")
    got = {(r.k, r.ts): r.sk for r in asof_join(fact, dim, "k", "k", "ts", "f", "t", ["sk"]).collect()}
    assert list(got.values()).count(None) == 2 and got["u", T(1)] == 1 and got["u", dt.datetime(2024, 3, 9)] == 2


def test_null_safe(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "i int, k string")
    b = spark.createDataFrame([(None, "n"), ("x", "m")], "k string, w string")
    assert rows(null_safe_join(a, b, ["k"]).select("i", "w")) == [(1, "n"), (2, "m")]


# --- sources, sinks, checks -----------------------------------------------------------


def test_partition_overwrite(spark):
    path = new_path(spark, "t")
    df = spark.createDataFrame([(1, "d1"), (2, "d2")], "n int, dt string")
    sinks.overwrite_partitions(df, path, "dt")
    sinks.overwrite_partitions(spark.createDataFrame([(9, "d2")], "n int, dt string"), path, "dt")
    assert rows(read_shards(spark, path, df.schema)) == [(1, "d1"), (9, "d2")]
    assert read_shards(spark, path, df.schema, day="d1").count() == 1


def test_dirty_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,x;\n2;,y\n")
    assert rows(read_dirty_csv(spark, str(tmp_path / "x.csv"), "a int, b string")) == [(1, "x"), (2, "y")]


def test_dirty_csv_keeps_what_is_quoted(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n;1,"x;y";\n2;,z\n')
    assert rows(read_dirty_csv(spark, str(tmp_path / "q.csv"), "a int, b string")) == [(1, "x;y"), (2, "z")]


def test_a_rewritten_table_is_read_with_its_new_schema(spark, tmp_path):
    for column in ("r_a", "r_b"):
        spark.range(2).withColumnRenamed("id", column).write.mode("overwrite").parquet(str(tmp_path / "region.parquet"))
        assert table(spark, str(tmp_path), "region").columns == [column] and table(spark, str(tmp_path), "region").count() == 2


def test_dirty_csv_bad_line_fails(spark):
    path = new_path(spark, "dirty-bad")
    spark.createDataFrame([("id,name",), ("1,a;",), ("x;,b",)], "value string").write.text(path)
    with pytest.raises(Exception, match="(?i)malformed"):
        read_dirty_csv(spark, path, "id int, name string").collect()


def test_date_spine(spark):
    assert date_spine(spark, "1992-01-08", "1992-01-11", inclusive=False).count() == 3
    assert date_spine(spark, "2010-01-01", "2020-12-31").count() == 4018


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    assert rows(quality.unique(df, "k")) == [(1, 2)]
    assert quality.not_null(df, "k").count() == 1
    assert quality.accepted_values(df, "v", ["a", "b"]).count() == 1
    assert quality.relationships(df, "k", spark.createDataFrame([(2,)], "id int"), "id").count() == 2
    assert quality.expression(df, "k > 0").count() == 1
    assert quality.unique_combination(df, ["k", "v"]).count() == 0
    assert quality.difference(df, df).count() == 0
    with pytest.raises(ValueError):
        quality.schema_contract(df, "k bigint, v string")
    broken = spark.createDataFrame([("u", T(1), T(3), False), ("u", T(2), T(9), False)], "k string, valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean")
    assert {r.problem for r in quality.scd2_integrity(broken, "k").collect()} == {"overlap", "current"}


def test_snap_check_reaches_every_visit(spark, root, monkeypatch):
    """All visits lie after the last set run."""
    real = modelling.visits
    monkeypatch.setattr(modelling, "visits", lambda *a: real(*a).withColumn("access_timestamp", F.col("access_timestamp") + F.expr("interval 60 days")))
    got = modelling.snap_check(spark, root)
    assert got.select("visitor_id").distinct().count() == real(spark, root, False).select("visitor_id").distinct().count()


def test_meal_time_counts_every_year(spark, root, monkeypatch):
    shown = lambda: sorted((r.meal_time_en, r.year_value, r.total_games) for r in QUERIES["anl_meal_time"](spark, root).collect())
    before, real = shown(), games.clocked
    monkeypatch.setattr(games, "clocked", lambda *a: real(*a).withColumn("year_value", F.col("year_value") + 20))
    assert before and shown() == [(meal, year + 20, n) for meal, year, n in before]


def test_pit_and_bridge_gather_no_satellite(spark):
    day = lambda m: dt.date(2020, m, 1)
    hub = spark.createDataFrame([("a", day(1)), ("b", day(3)), (None, day(1))], "pk string, load_date date")
    one = spark.createDataFrame([("a", day(2)), ("a", day(4)), ("a", day(4)), ("b", None), (None, day(1))], "pk string, load_date date")
    two = spark.createDataFrame([("b", day(1)), ("c", day(1))], "pk string, load_date date")
    as_of = spark.createDataFrame([(day(m),) for m in (1, 3, 5)], "as_of_date date")
    out = dv.pit(hub, "pk", as_of, {"one": one, "two": two})
    none, ghost = dv.GHOST_PK, dt.date(1900, 1, 1)
    assert out.columns == ["pk", "as_of_date", "one_ldts", "one_pk", "two_ldts", "two_pk"]
    assert rows(out) == sorted([
        ("a", day(1), ghost, none, ghost, none), ("a", day(3), day(2), "a", ghost, none), ("a", day(5), day(4), "a", ghost, none),
        ("b", day(3), ghost, none, day(1), "b"), ("b", day(5), ghost, none, day(1), "b"),
        *[(None, day(m), ghost, none, ghost, none) for m in (1, 3, 5)]], key=repr)
    link = spark.createDataFrame([("x", "a"), ("y", "b"), ("z", "b")], "link_pk string, pk string")
    eff = spark.createDataFrame([("x", day(1), day(2)), ("x", day(3), dt.date(9999, 12, 31)), ("y", day(1), day(2)), ("z", day(4), day(9))],
                                "link_pk string, load_date date, end date")
    bridged = dv.bridge(hub, "pk", as_of, [dv.Step(link, "link_pk", "pk", eff, "end", "hop")])
    assert rows(bridged) == sorted([
        ("a", day(1), "x", day(2), day(1)), ("a", day(3), "x", dt.date(9999, 12, 31), day(3)), ("a", day(5), "x", dt.date(9999, 12, 31), day(3)),
        ("b", day(5), "z", day(9), day(4))], key=repr)
    for df in (out, bridged):  # the stored tables are taken for smaller than they are: nothing of them may go to the driver
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_sat_compares_with_the_version_before(spark):
    """Random loads on random states, with null and equal dates, against a plain walk in order of dates."""
    rng = random.Random(6)
    day = lambda: rng.choice([None, *[dt.date(2020, 1, n) for n in range(1, 6)]])
    schema = "pk string, hd string, x int, eff date, load_date date, src string"
    row = lambda k: (k, rng.choice("abc"), rng.randrange(3), dt.date(2020, 1, 1), day(), "s")
    batch, stored = ([row(f"k{rng.randrange(60)}") for _ in range(n)] + [row(None)] for n in (300, 90))
    early = lambda d: (d is not None, d or dt.date.min)
    for state in (None, stored):
        want = []
        for k in {r[0] for r in batch} - {None}:
            one = {}
            for r in batch:
                if r[0] == k:
                    one[r[4]] = min(one.get(r[4], r), r, key=lambda z: (z[1], z[3], z[5], z[2]))
            line = [(early(d), 1, r[1], r) for d, r in one.items()]
            if held := [r for r in state or () if r[0] == k]:
                last = max(held, key=lambda z: (early(z[4]), z[1]))
                line.append((early(last[4]), 0, last[1], None))
            line.sort(key=lambda z: z[:2])
            want += [r for i, (_, _, h, r) in enumerate(line) if r and (not i or line[i - 1][2] != h)]
        old = state and spark.createDataFrame(state, schema)
        got = dv.sat(spark.createDataFrame(batch, schema), "pk", "hd", ["x"], "eff", "load_date", "src", old)
        assert rows(got) == sorted(want, key=repr)
    md5 = lambda r: (r[0] and hashlib.md5(r[0].encode()).hexdigest(), hashlib.md5(r[1].encode()).hexdigest(), *r[2:4], dt.date(2020, 1, 3), r[5])
    now, old = spark.createDataFrame([md5(r) for r in batch], schema), spark.createDataFrame([*map(md5, stored), ("0" * 32, "0" * 32, 1, None, day(), "s")], schema)
    for state in (None, old, old.withColumn("load_date", F.date_add("load_date", 2))):
        plain = dv.sat(now, "pk", "hd", ["x"], "eff", "load_date", "src", state)
        packed = dv.sat(now, "pk", "hd", ["x"], "eff", "load_date", "src", state, digests=True, one_date=True)
        assert plain.dtypes == packed.dtypes and rows(plain) == rows(packed)


def test_stored_loads_shuffle_a_sat_once(spark, root):
    """A key's hash and what is compared travel once, as 16 bytes each; they do not travel again for a window."""
    state = vault_plans.sat_of(spark, root, "inventory", 1)
    plan = vault_plans.sat_of(spark, root, "inventory", 2, state.localCheckpoint())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2 and "Window" not in plan


def test_whole_orders_get_narrow_lines(spark, tmp_path):
    put = lambda name, given, schema: spark.createDataFrame(given, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    when = dt.datetime(1997, 1, 2)
    put("region", [(0, "R")], "r_regionkey int, r_name string")
    put("nation", [(0, "N", 0), (1, "M", None)], "n_nationkey int, n_name string, n_regionkey int")
    put("customer", [(1, "c", 0, 1.5, "m"), (1, "d", 1, 2.5, "m"), (None, "e", 0, 0.0, "m")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    put("supplier", [(1, "s", 0, 1.0), (1, "t", None, 1.0), (2, "u", 1, 1.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    put("part", [(1, "p"), (1, "q"), (None, "r")], "p_partkey long, p_name string")
    put("orders", [(1, 1, "O", 10.0, when, "x"), (2, 9, "F", 20.0, when, "x"), (3, None, "F", None, None, None), (None, 1, "F", 1.0, when, "x"), (2, 1, "F", 5.0, when, "y")],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    put("lineitem", [(1, 1, 1, 1, 1.0, 2.0, 0.1, 0.2, "A", "F", when), (1, None, 2, 2, 1.0, 2.0, 0.1, 0.2, "A", "F", when), (2, 1, None, 1, None, 2.0, 0.1, 0.2, None, "F", None),
                     (2, 7, 2, 1, 1.0, 2.0, 0.1, 0.2, "A", "F", when), (None, 1, 1, 1, 1.0, 2.0, 0.1, 0.2, "A", "F", when)] * 2,
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        staged = vault_plans.stage_orders(spark, str(tmp_path))
        text = staged._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        dealt = re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning\((\w+)#", text)
        assert {key for _, key in dealt} >= {"l_partkey", "l_suppkey", "l_orderkey"}
        assert not [c for c, key in dealt if key in ("l_partkey", "l_suppkey") and re.search(r"\b[oc]_", c)]
        raw = QUERIES["dv_raw_orders"](spark, str(tmp_path))
        lines = vault_plans.raw_orders(spark, str(tmp_path))
        assert raw.dtypes == lines.dtypes and raw.count() > 20 and rows(raw) == rows(lines)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
