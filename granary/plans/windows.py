"""Window functions. Keyed ones work on range partitions, so one key may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.values import floor_round, money
from granary.operators.ordered import (
    global_dense_rank, global_rank, global_row_number, keyed_dense_rank, keyed_row_number, keyed_running, keyed_shift, latest_per_key,
)
from granary.operators.stats import deadlines_met, greedy_fill, interval_schedule
from granary.plans.duck import fr
from granary.plans.registry import open_ended, query
from granary.sources import adapters as A
from granary.sources.tables import table


def _t(spark: SparkSession, root: str, name: str) -> DataFrame:
    return table(spark, root, name)


query("win_row_number_partitioned", "select o_orderkey, o_custkey, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as integer) as rn from orders")(
    lambda spark, root: keyed_row_number(_t(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey",
                                         [F.col("o_orderdate"), F.col("o_orderkey")], "rn").drop("o_orderdate"))
query("win_row_number_latest", "select user_id, event_id, ts, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) q where rn=1")(
    lambda spark, root: latest_per_key(_t(spark, root, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", [F.col("ts"), F.col("event_id")]))
query("win_global_row_number", "select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as sk from orders")(
    lambda spark, root: global_row_number(_t(spark, root, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")], "sk").drop("o_orderdate"))
query("win_global_dense_rank", "select o_orderkey, dense_rank() over (order by o_orderdate, o_custkey)+1000 as sk from orders")(
    lambda spark, root: global_dense_rank(_t(spark, root, "orders").select("o_orderkey", "o_orderdate", "o_custkey"), ["o_orderdate", "o_custkey"], "sk", start=1000)
    .select("o_orderkey", "sk"))


def daily(spark: SparkSession, root: str) -> DataFrame:
    """One row per order date. The windows below run on these few thousand rows."""
    return _t(spark, root, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(money("o_totalprice")).cast("decimal(28,2)").alias("total"))


DAILY = "with daily as (select cast(o_orderdate as date) as d, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(28,2)) as total from orders group by 1)"


def in_year():
    return W.partitionBy(F.year("d"))


def in_month():
    return W.partitionBy(F.year("d"), F.month("d"))


def by_day():
    return W.orderBy("d")



query("win_rank", DAILY + """ select d, total, cast(rank() over (partition by year(d) order by total desc) as integer) as year_rank,
  cast(rank() over (partition by year(d), month(d) order by total desc) as integer) as month_rank, cast(rank() over (order by total desc) as integer) as all_rank from daily""")(
    lambda spark, root: daily(spark, root).select("d", "total", F.rank().over(in_year().orderBy(F.desc("total"))).alias("year_rank"),
                                                  F.rank().over(in_month().orderBy(F.desc("total"))).alias("month_rank"), F.rank().over(W.orderBy(F.desc("total"))).alias("all_rank")))
query("win_dense_rank", DAILY + " select d, n, cast(dense_rank() over (partition by year(d), quarter(d) order by n desc) as integer) as quarter_rank from daily")(
    lambda spark, root: daily(spark, root).select("d", "n", F.dense_rank().over(W.partitionBy(F.year("d"), F.quarter("d")).orderBy(F.desc("n"))).alias("quarter_rank")))


def lag_change(spark: SparkSession, root: str) -> DataFrame:
    e = _t(spark, root, "events").select("event_id", "user_id", "ts", "event_type")
    out = keyed_shift(e, "user_id", [F.col("ts"), F.col("event_id")], {"before": F.col("event_type")})
    return out.where(F.col("before").isNull() | (F.col("before") != F.col("event_type"))).select("event_id", "user_id", "event_type", "before")


query("win_lag_change", """select event_id, user_id, event_type, before from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) q
  where before is null or before<>event_type""")(lag_change)


def lead_validity(spark: SparkSession, root: str) -> DataFrame:
    e = _t(spark, root, "events").select("event_id", "user_id", "ts")
    out = keyed_shift(e, "user_id", [F.col("ts"), F.col("event_id")], {"nx": F.col("ts")}, back=False)
    high = F.lit("9999-12-31").cast("timestamp_ntz")
    return out.select("event_id", "user_id", F.col("ts").alias("valid_from"), F.coalesce(F.col("nx") - F.expr("interval 1 second"), high).alias("valid_to"))


open_ended("win_lead_validity", """select event_id, user_id, ts as valid_from, coalesce(lead(ts) over (partition by user_id order by ts, event_id) - interval 1 second, timestamp '9999-12-31') as valid_to from events""")(lead_validity)
query("win_lag_offset", DAILY + " select d, lag(n,1) over w as p1, lag(n,30) over w as p30, lag(n,365) over w as p365 from daily window w as (order by d)")(
    lambda spark, root: daily(spark, root).select("d", *[F.lag("n", k).over(by_day()).alias(f"p{k}") for k in (1, 30, 365)]))


def running_sum(spark: SparkSession, root: str) -> DataFrame:
    o = _t(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderdate", money("o_totalprice").alias("p"))
    out = keyed_running(o, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], {"lifetime": F.col("p")})
    return out.select("o_orderkey", "o_custkey", F.col("lifetime").cast("decimal(38,2)").alias("lifetime"))


query("win_running_sum", """select o_orderkey, o_custkey, cast(sum(cast(o_totalprice as decimal(18,2))) over (partition by o_custkey order by o_orderdate, o_orderkey
  rows unbounded preceding) as decimal(38,2)) as lifetime from orders""")(running_sum)
query("win_moving_avg", DAILY + " select d, " + fr("avg(n) over (order by d rows between 6 preceding and current row)", 4) + " as ma7, " +
      fr("avg(n) over (order by d rows between 29 preceding and current row)", 4) + " as ma30 from daily")(
    lambda spark, root: daily(spark, root).select("d", floor_round(F.avg("n").over(by_day().rowsBetween(-6, 0)), 4).alias("ma7"), floor_round(F.avg("n").over(by_day().rowsBetween(-29, 0)), 4).alias("ma30")))
query("win_partition_totals", DAILY + """ select d, cast(sum(n) over (partition by year(d), month(d)) as bigint) as month_n, cast(sum(n) over (partition by year(d)) as bigint) as year_n,
  max(total) over (partition by year(d)) as year_max, cast(sum(total) over (partition by year(d), month(d)) as decimal(38,2)) as month_total from daily""")(
    lambda spark, root: daily(spark, root).select("d", F.sum("n").over(in_month()).alias("month_n"), F.sum("total").over(in_month()).cast("decimal(38,2)").alias("month_total"),
                                                  F.sum("n").over(in_year()).alias("year_n"), F.max("total").over(in_year()).alias("year_max")))
query("win_conditional_count", DAILY + " select d, count(case when n>6 then 1 end) over (partition by year(d), month(d)) as busy_days from daily")(
    lambda spark, root: daily(spark, root).select("d", F.count(F.when(F.col("n") > 6, 1)).over(in_month()).alias("busy_days")))


def rank_then_dense(spark: SparkSession, root: str) -> DataFrame:
    """Lines of each order's latest ship date, ranked by part. The latest date is an aggregate joined back."""
    li = _t(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    last = li.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("l_shipdate"))
    rows = li.join(last, ["l_orderkey", "l_shipdate"]).select("l_orderkey", "l_linenumber", "l_partkey")
    return keyed_dense_rank(rows, "l_orderkey", "l_partkey", "check_rank")


query("win_rank_then_dense", """select l_orderkey, l_linenumber, l_partkey, cast(dense_rank() over (partition by l_orderkey order by l_partkey) as integer) as check_rank from (
  select *, rank() over (partition by l_orderkey order by l_shipdate desc) as r from lineitem) q where r=1""")(rank_then_dense)
query("win_order_statistic", "select o_orderkey, rank() over (order by o_totalprice)-1 as n_smaller from orders")(
    lambda spark, root: global_rank(_t(spark, root, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], "r").select("o_orderkey", (F.col("r") - 1).alias("n_smaller")))

NEED = 100


def fill(spark: SparkSession, root: str) -> DataFrame:
    li = _t(spark, root, "lineitem").select("l_partkey", money("l_extendedprice").alias("price"), F.col("l_quantity").cast("bigint").alias("qty"))
    return greedy_fill(li, "l_partkey", "price", "qty", NEED, [F.col("price"), F.col("qty")])


query("win_greedy_fill", f"""select l_partkey, cast(sum(t) as bigint) as units, cast(sum(p*t) as decimal(38,2)) as cost from (
  select l_partkey, p, greatest(0, least(q, {NEED}-(sum(q) over (partition by l_partkey order by p, q rows unbounded preceding)-q))) as t from (
    select l_partkey, cast(l_extendedprice as decimal(18,2)) as p, cast(l_quantity as bigint) as q from lineitem) a) b group by 1""")(fill)


def feasible(spark: SparkSession, root: str) -> DataFrame:
    o = _t(spark, root, "orders").selectExpr("o_custkey", "o_orderkey", "o_orderkey % 400 as work", "cast(datediff(o_orderdate, date'1995-01-01') as bigint) as deadline")
    return deadlines_met(o, "o_custkey", "work", "deadline", [F.col("deadline"), F.col("o_orderkey")])


query("win_deadline_feasible", """select o_custkey, bool_and(done<=deadline) as feasible, cast(sum(work) as bigint) as total_work from (
  select o_custkey, work, deadline, sum(work) over (partition by o_custkey order by deadline, o_orderkey rows unbounded preceding) as done from (
    select o_custkey, o_orderkey, o_orderkey%400 as work, datediff('day', date '1995-01-01', cast(o_orderdate as date)) as deadline from orders) a) b group by 1""")(feasible)


def schedule(spark: SparkSession, root: str) -> DataFrame:
    """Events as intervals of `value` minutes; how many fit without overlap per user."""
    e = _t(spark, root, "events").selectExpr("user_id", f"timestampdiff(MICROSECOND, {A.EPOCH}, ts) as s", "cast(cast(value as decimal(18,2)) * 60000000 as bigint) as len")
    return interval_schedule(e.selectExpr("user_id", "s", "s + len as e"), "user_id", "s", "e")


query("win_interval_schedule", """with recursive iv as (select user_id, epoch_us(ts) as s, epoch_us(ts)+cast(cast(value as decimal(18,2))*60000000 as bigint) as e from events),
r as (select user_id, min(e) as last from iv group by 1 union all select * from (select r.user_id, (select min(iv.e) from iv where iv.user_id=r.user_id and iv.s>=r.last) as last from r) q where last is not null)
select user_id, count(*) as n_chosen from r group by 1""")(schedule)
