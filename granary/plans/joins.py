"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.values import money
from granary.operators import dims
from granary.operators.ordered import global_prefix_sum, latest_per_key
from granary.plans import vault as V
from granary.plans.calendar import order_calendar
from granary.plans.duck import with_
from granary.plans.modelling import DIM_USERS, dim_users, fct_visits, visits
from granary.operators.joins import asof_join
from granary.plans.duck import surrogate
from granary.plans.registry import query
from granary.sources import adapters as A
from granary.sources.tables import table


def inner_chain(spark: SparkSession, root: str) -> DataFrame:
    li, o, c, n = (table(spark, root, t) for t in ("lineitem", "orders", "customer", "nation"))
    return (
        li.join(o, F.expr("l_orderkey = o_orderkey")).join(c, F.expr("o_custkey = c_custkey")).join(n, F.expr("c_nationkey = n_nationkey"))
        .groupBy("n_name", "l_returnflag").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(money("l_extendedprice")).cast("decimal(28,2)").alias("revenue"))
    )


query("join_inner_chain", """select n_name, l_returnflag, count(*) as n_lines, cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(28,2)) as revenue from lineitem
  join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey group by 1,2""")(inner_chain)
query("join_left_chain", with_("ro", " select orderkey, linenumber, customer_name, customer_region_name, part_name, supplier_name, supplier_region_name from ro"))(
    lambda spark, root: V.raw_orders(spark, root).select("orderkey", "linenumber", "customer_name", "customer_region_name", "part_name", "supplier_name", "supplier_region_name"))


def composite(spark: SparkSession, root: str) -> DataFrame:
    ps = A.partsupp(spark, root)
    li = table(spark, root, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey as ps_partkey", "l_suppkey as ps_suppkey")
    return li.join(ps, ["ps_partkey", "ps_suppkey"])


query("join_composite_key", with_("ps", " select l_orderkey, l_linenumber, ps.* from lineitem join ps on l_partkey=ps_partkey and l_suppkey=ps_suppkey"))(composite)


def cross_spine(spark: SparkSession, root: str) -> DataFrame:
    """Hours by minutes with the events of each; the spine is generated, not joined.

    Both sides are fixed (24 and 60), so the pairs come from one range of 1,440 numbers.
    """
    spine = dims.time_of_day(spark).select("hour_value", "minute_value")
    n = table(spark, root, "events").groupBy(F.hour("ts").alias("hour_value"), F.minute("ts").alias("minute_value")).agg(F.count(F.lit(1)).alias("n_events"))
    return spine.join(n, ["hour_value", "minute_value"], "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))


query("join_cross", """select cast(h.range as integer) as hour_value, cast(m.range as integer) as minute_value, count(ts) as n_events from range(24) h cross join range(60) m
  left join events on hour(ts)=h.range and minute(ts)=m.range group by 1,2""")(cross_spine)


def asof(spark: SparkSession, root: str, closed: bool = True) -> DataFrame:
    v = visits(spark, root, False).select("visit_id", "visitor_id", "access_timestamp")
    d = dim_users(spark, root)
    return asof_join(v, d, "visitor_id", "visitor_id", "access_timestamp", "valid_from", "valid_to", ["device_category", "is_current"], closed=closed)


_ASOF = " select visit_id, v.visitor_id, access_timestamp, d.device_category, d.is_current from visits v left join d on v.visitor_id=d.visitor_id and v.access_timestamp "
query("join_asof_scd", with_("visits", DIM_USERS + _ASOF + "between d.valid_from and d.valid_to"))(lambda spark, root: asof(spark, root))
query("join_asof_scd_halfopen", with_("visits", DIM_USERS + _ASOF + ">= d.valid_from and v.access_timestamp < d.valid_to"))(lambda spark, root: asof(spark, root, closed=False))
query("join_using", "select l_orderkey as orderkey, l_linenumber, o_orderdate from lineitem join orders on l_orderkey=o_orderkey")(
    lambda spark, root: table(spark, root, "lineitem").selectExpr("l_orderkey as orderkey", "l_linenumber")
    .join(table(spark, root, "orders").selectExpr("o_orderkey as orderkey", "o_orderdate"), "orderkey"))
query("join_anti_left_null", "select o_orderkey from orders left join lineitem on o_orderkey=l_orderkey where l_orderkey is null")(
    lambda spark, root: table(spark, root, "orders").join(table(spark, root, "lineitem"), F.expr("o_orderkey = l_orderkey"), "left_anti").select("o_orderkey"))
query("join_not_in", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)")(
    lambda spark, root: table(spark, root, "customer").join(
        # The keys are declared non-null, so an anti join is NOT IN.
        table(spark, root, "orders").where("o_custkey is not null"), F.expr("c_custkey = o_custkey"), "left_anti").select("c_custkey"))


def exists_semi(spark: SparkSession, root: str) -> DataFrame:
    """Customers with an order none of whose lines was returned."""
    returned = table(spark, root, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    clean = table(spark, root, "orders").join(returned, "o_orderkey", "left_anti")
    return table(spark, root, "customer").join(clean, F.expr("c_custkey = o_custkey"), "left_semi").select("c_custkey", "c_name")


query("join_exists_semi", """select c_custkey, c_name from customer c where exists (select 1 from orders o where o.o_custkey=c.c_custkey
  and not exists (select 1 from lineitem l where l.l_orderkey=o.o_orderkey and l_returnflag='R'))""")(exists_semi)


def scalar_max(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders")
    return o.where(F.col("o_orderdate") == o.agg(F.max("o_orderdate")).scalar())


query("join_scalar_subquery_max", "select * from orders where o_orderdate = (select max(o_orderdate) from orders)")(scalar_max)


def self_max(spark: SparkSession, root: str) -> DataFrame:
    """Latest order per customer by one aggregate instead of a self-join."""
    o = table(spark, root, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return latest_per_key(o, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")])


query("join_self_max_latest", """select o_custkey, o_orderkey, o_orderdate, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn
  from orders) q where rn=1""")(self_max)


def densify(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "lineitem").groupBy(F.to_date("l_shipdate").alias("date_value")).agg(F.count(F.lit(1)).alias("n"), F.sum(money("l_extendedprice")).cast("decimal(28,2)").alias("revenue"))
    cal = order_calendar(spark, root).select("date_value", "year_month_int", "is_weekend")
    return cal.join(n, "date_value", "left").withColumn("n", F.coalesce("n", F.lit(0)))


query("join_calendar_densify", """with days as (select cast(unnest(generate_series(min(o_orderdate), max(o_orderdate), interval 1 day)) as date) as d from orders)
select d as date_value, cast(strftime(d,'%Y%m') as integer) as year_month_int, dayofweek(d) in (0,6) as is_weekend, count(l_orderkey) as n,
  cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(28,2)) as revenue from days left join lineitem on cast(l_shipdate as date)=d group by 1,2,3""")(densify)


def role_playing(spark: SparkSession, root: str) -> DataFrame:
    """Line counts by customer nation and supplier nation: the same dimension twice."""
    li, o, c, s, n = (table(spark, root, t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
    cn = n.selectExpr("n_nationkey as cnk", "n_name as customer_nation")
    sn = n.selectExpr("n_nationkey as snk", "n_name as supplier_nation")
    return (
        li.join(o, F.expr("l_orderkey = o_orderkey")).join(c, F.expr("o_custkey = c_custkey")).join(s, F.expr("l_suppkey = s_suppkey"))
        .join(cn, F.expr("c_nationkey = cnk")).join(sn, F.expr("s_nationkey = snk"))
        .groupBy("customer_nation", "supplier_nation").agg(F.count(F.lit(1)).alias("n_lines"))
    )


query("join_role_playing", """select cn.n_name as customer_nation, sn.n_name as supplier_nation, count(*) as n_lines from lineitem join orders on l_orderkey=o_orderkey
  join customer on o_custkey=c_custkey join supplier on l_suppkey=s_suppkey join nation cn on c_nationkey=cn.n_nationkey join nation sn on s_nationkey=sn.n_nationkey group by 1,2""")(role_playing)


def fact_dim_star(spark: SparkSession, root: str) -> DataFrame:
    d = dim_users(spark, root).select("user_sk", "country", "device_category")
    return fct_visits(spark, root).join(d, "user_sk").groupBy("country", "device_category").agg(F.sum("hits").alias("hits"), F.countDistinct("user_sk").alias("versions"))


query("join_fact_dim_star", with_("visits", DIM_USERS + f""", r as (select {surrogate('visitor_id', "strftime(valid_from,'%Y-%m-%d %H:%M:%S')")} as user_sk, * from d)
select r.country, r.device_category, cast(sum(hits) as bigint) as hits, count(distinct user_sk) as versions from visits v join r on v.visitor_id=r.visitor_id
  and v.access_timestamp between r.valid_from and r.valid_to group by 1,2"""))(fact_dim_star)


def pairs_below(spark: SparkSession, root: str) -> DataFrame:
    """How many (a, b, c) with a < b < c, a from part sizes, b from quantities, c from sizes again.

    Values are counted first; prefix sums over the distinct values then give, for each b,
    the number of smaller a and larger c. No pair is ever built.
    """
    p = table(spark, root, "part").selectExpr("cast(p_size as bigint) as v", "1 as a", "0 as b", "1 as c")
    q = table(spark, root, "lineitem").selectExpr("cast(l_quantity as bigint) as v", "0 as a", "1 as b", "0 as c")
    counts = p.unionByName(q).groupBy("v").agg(*[F.sum(x).alias(x) for x in "abc"])
    below = global_prefix_sum(counts, [F.col("v")], {"a_below": F.col("a"), "c_below": F.col("c")})
    total = counts.agg(F.sum("c")).scalar()
    wide = below.withColumn("c_above", total - F.col("c_below") - F.col("c"))
    return wide.agg(
        F.sum(F.expr("cast(a_below as decimal(19,0)) * cast(b as decimal(19,0))")).cast("decimal(38,0)").alias("pairs"),
        F.sum(F.expr("cast(cast(a_below as decimal(18,0)) * cast(b as decimal(18,0)) as decimal(20,0)) * cast(c_above as decimal(17,0))")).cast("decimal(38,0)").alias("triples"))


query("join_pairs_below", """with a as (select p_size as v, count(*) as n from part group by 1), b as (select cast(l_quantity as bigint) as v, count(*) as n from lineitem group by 1)
select cast(sum(b.n*coalesce((select sum(a.n) from a where a.v<b.v),0)) as decimal(38,0)) as pairs,
  cast(sum(b.n*coalesce((select sum(a.n) from a where a.v<b.v),0)*coalesce((select sum(a.n) from a where a.v>b.v),0)) as decimal(38,0)) as triples from b""")(pairs_below)
