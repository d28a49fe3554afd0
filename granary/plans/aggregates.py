"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.values import exact_avg, floor_round, money
from granary.operators.stats import mean_median_mode, spread_and_second
from granary.plans.duck import fr
from granary.plans.registry import query
from granary.sources.tables import number_spine, table


def _t(spark: SparkSession, root: str, name: str) -> DataFrame:
    return table(spark, root, name)


def basic(spark: SparkSession, root: str) -> DataFrame:
    return _t(spark, root, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(money("o_totalprice")).cast("decimal(28,2)").alias("total"),
        exact_avg(F.sum(money("o_totalprice")), F.count(F.lit(1))).alias("mean"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


query("agg_basic", """select o_custkey, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(28,2)) as total,
  cast(sum(cast(o_totalprice as decimal(18,2))) as double)/count(*) as mean, min(o_orderdate) as first, max(o_orderdate) as last from orders group by 1""")(basic)
query("agg_count_distinct_multi", "select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers, count(distinct l_orderkey) as orders from lineitem group by 1")(
    lambda spark, root: _t(spark, root, "lineitem").groupBy("l_returnflag").agg(
        F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_orderkey").alias("orders")))
query("agg_conditional_sum", """select l_suppkey, cast(sum(case when l_returnflag='R' then cast(l_extendedprice as decimal(18,2)) else 0 end) as decimal(28,2)) as returned,
  cast(sum(case when l_linestatus='F' then 1 else 0 end) as bigint) as finished from lineitem group by 1""")(
    lambda spark, root: _t(spark, root, "lineitem").groupBy("l_suppkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "R", money("l_extendedprice")).otherwise(F.lit(0).cast("decimal(18,2)"))).cast("decimal(28,2)").alias("returned"),
        F.sum(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("finished")))
query("agg_conditional_count_distinct", """select cast(year(o_orderdate) as integer) as year, count(distinct case when o_orderstatus='O' then o_custkey end) as open_customers,
  count(distinct case when dayofweek(o_orderdate) in (0,6) then o_custkey end) as weekend_customers from orders group by 1""")(
    lambda spark, root: _t(spark, root, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(
        F.countDistinct(F.when(F.col("o_orderstatus") == "O", F.col("o_custkey"))).alias("open_customers"),
        F.countDistinct(F.when(F.dayofweek("o_orderdate").isin(1, 7), F.col("o_custkey"))).alias("weekend_customers")))


def by_month(spark: SparkSession, root: str) -> DataFrame:
    """Twelve monthly averages per status as columns, from one pivot over sums and counts."""
    o = _t(spark, root, "orders").select("o_orderstatus", F.month("o_orderdate").alias("m"), money("o_totalprice").alias("p"))
    wide = o.groupBy("o_orderstatus").pivot("m", list(range(1, 13))).agg(F.sum("p").alias("s"), F.count("p").alias("n"))
    return wide.select("o_orderstatus", *[exact_avg(F.col(f"{m}_s"), F.col(f"{m}_n")).alias(f"avg_{m:02d}") for m in range(1, 13)])


query("agg_conditional_avg", "select o_orderstatus, " + ", ".join(
    f"cast(sum(case when month(o_orderdate)={m} then cast(o_totalprice as decimal(18,2)) end) as double)/count(case when month(o_orderdate)={m} then 1 end) as avg_{m:02d}"
    for m in range(1, 13)) + " from orders group by 1")(by_month)
query("agg_stddev", "select l_suppkey, round(stddev_samp(l_quantity),4) as sd from lineitem group by 1")(
    lambda spark, root: _t(spark, root, "lineitem").groupBy("l_suppkey").agg(F.round(F.stddev_samp("l_quantity"), 4).alias("sd")))


def pivot_dynamic(spark: SparkSession, root: str) -> DataFrame:
    """One count column per order status found in the data."""
    wide = _t(spark, root, "orders").groupBy("o_custkey").pivot("o_orderstatus").agg(F.count(F.lit(1)))
    return wide.select("o_custkey", *[F.coalesce(F.col(c), F.lit(0)).alias(f"n_{c}") for c in wide.columns[1:]])


query("agg_pivot_dynamic", "select o_custkey, " + ", ".join(f"count(*) filter (where o_orderstatus='{s}') as \"n_{s}\"" for s in "FOP") + " from orders group by 1")(pivot_dynamic)


def grouping_sets(spark: SparkSession, root: str) -> DataFrame:
    o = _t(spark, root, "orders").select(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), F.month("o_orderdate").alias("m"), money("o_totalprice").alias("p"))
    # Rows are combined to month grain first, so the four-fold expansion is over months.
    months = o.groupBy("y", "q", "m").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("n"))
    return spark.sql("""select y, q, m, case grouping_id(y, q, m) when 7 then 'ALL' when 3 then 'YEAR' when 1 then 'YEAR_QUARTER' else 'YEAR_MONTH' end as level,
        sum(n) as n, cast(sum(p) as decimal(38,2)) as total from {months} group by grouping sets ((), (y), (y, q), (y, q, m))""", months=months)


query("agg_grouping_sets", """with o as (select cast(year(o_orderdate) as integer) as y, cast(quarter(o_orderdate) as integer) as q, cast(month(o_orderdate) as integer) as m, cast(o_totalprice as decimal(18,2)) as p from orders)
select null::integer as y, null::integer as q, null::integer as m, 'ALL' as level, count(*) as n, cast(sum(p) as decimal(38,2)) as total from o
union all select y, null, null, 'YEAR', count(*), cast(sum(p) as decimal(38,2)) from o group by y
union all select y, q, null, 'YEAR_QUARTER', count(*), cast(sum(p) as decimal(38,2)) from o group by y, q
union all select y, q, m, 'YEAR_MONTH', count(*), cast(sum(p) as decimal(38,2)) from o group by y, q, m""")(grouping_sets)
query("agg_distinct_rows", "select distinct p_brand, p_type from part")(lambda spark, root: _t(spark, root, "part").select("p_brand", "p_type").distinct())
query("agg_group_by_all", "select o_custkey, o_orderstatus, min(o_orderdate) as first from orders group by all")(
    lambda spark, root: spark.sql("select o_custkey, o_orderstatus, min(o_orderdate) as first from {o} group by all", o=_t(spark, root, "orders")))
query("agg_having_flag", """select o_custkey, count(distinct o_orderkey)>1 as is_repeat, case when count(distinct o_orderkey)>1 then 'returning' else 'new' end as kind from orders group by 1""")(
    lambda spark, root: _t(spark, root, "orders").groupBy("o_custkey").agg((F.countDistinct("o_orderkey") > 1).alias("is_repeat"))
    .withColumn("kind", F.when(F.col("is_repeat"), "returning").otherwise("new")))
query("agg_safe_ratio", "select l_suppkey, " + fr("100.0*cast(r as double)/nullif(f,0)", 2) + " as pct from (select l_suppkey, count(*) filter (where l_returnflag='R') as r, count(*) filter (where l_linestatus='F') as f from lineitem group by 1) q")(
    lambda spark, root: _t(spark, root, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_linestatus") == "F").alias("f"))
    .select("l_suppkey", floor_round(F.lit(100.0) * F.col("r").cast("double") / F.nullif("f", F.lit(0)), 2).alias("pct")))
query("agg_latest_per_key", "select user_id, event_type, max(ts) as updated_at from events group by 1,2")(
    lambda spark, root: _t(spark, root, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("updated_at")))


def hour_histogram(spark: SparkSession, root: str) -> DataFrame:
    n = _t(spark, root, "events").groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return number_spine(spark, 0, 23, "hour").join(n, "hour", "left").withColumn("n", F.coalesce("n", F.lit(0)))


query("agg_hour_histogram", "select cast(h.range as integer) as hour, count(ts) as n from range(24) h left join events on hour(ts)=h.range group by 1")(hour_histogram)
query("agg_median_mode_mean", """with v as (select l_suppkey, cast(l_quantity as bigint) as v from lineitem),
s as (select l_suppkey, list(v order by v) as l, cast(sum(v) as bigint)//count(*) as mean from v group by 1),
c as (select l_suppkey, v, row_number() over (partition by l_suppkey order by count(*) desc, v) as rn from v group by 1,2)
select s.l_suppkey, mean, l[len(l)//2+1] as median, c.v as mode from s join c on c.l_suppkey=s.l_suppkey and rn=1""")(
    lambda spark, root: mean_median_mode(_t(spark, root, "lineitem"), "l_suppkey", F.col("l_quantity").cast("bigint")))


def words(df: DataFrame, text: str) -> DataFrame:
    """One row per whitespace-separated word of the whole text."""
    return df.select("*", F.explode(F.split(F.col(text), r"\s+")).alias("word")).where("word <> ''")


query("agg_word_count", "select word, count(*) as n from (select unnest(regexp_split_to_array(text, '\\s+')) as word from documents) q where word<>'' group by 1")(
    lambda spark, root: words(_t(spark, root, "documents"), "text").groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def array_avg(values):
    """Whole-number mean of an array of integers; null when it is empty."""
    return F.expr(f"aggregate({values}, 0L, (a, x) -> a + x) div nullif(size({values}), 0)")


query("agg_array_avg", """select doc_id, cast(list_sum(l) as bigint)//nullif(len(l),0) as mean_word_length from (
  select doc_id, list_transform(list_filter(regexp_split_to_array(text,'\\s+'), lambda w: w<>''), lambda w: length(w)) as l from documents) q""")(
    lambda spark, root: _t(spark, root, "documents").select("doc_id", F.expr(r"transform(filter(split(text, '\\s+'), w -> w <> ''), w -> cast(length(w) as bigint))").alias("l"))
    .select("doc_id", array_avg("l").alias("mean_word_length")))
query("agg_filter_map_sum", "select cast(sum(v*v) as decimal(38,0)) as total from (select cast(l_quantity as decimal(18,0)) as v from lineitem where cast(l_quantity as bigint)%2=0) q")(
    lambda spark, root: _t(spark, root, "lineitem").where("cast(l_quantity as bigint) % 2 = 0").agg(
        F.sum(F.expr("cast(l_quantity as decimal(18,0)) * cast(l_quantity as decimal(18,0))")).cast("decimal(38,0)").alias("total")))


def partial_final(spark: SparkSession, root: str) -> DataFrame:
    """Plain aggregates: Spark sums on the map side first and merges the partial sums (asserted in tests/test_plans.py)."""
    total = F.sum(money("l_extendedprice")).cast("decimal(38,2)")
    return _t(spark, root, "lineitem").agg(total.alias("merged"), F.countDistinct(F.col("l_orderkey") % 16).alias("chunks"), total.alias("direct"))


query("agg_partial_final", """select cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(38,2)) as merged, count(distinct l_orderkey%16) as chunks,
  cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(38,2)) as direct from lineitem""")(partial_final)
query("agg_spread_second_min", """with v as (select l_suppkey, cast(l_quantity as bigint) as v, row_number() over (partition by l_suppkey order by l_quantity) as rn,
  dense_rank() over (partition by l_suppkey order by l_quantity) as dr from lineitem)
select l_suppkey, max(v)-min(v) as spread, max(case when rn=2 then v end) as second_smallest, max(case when dr=2 then v end) as second_distinct from v group by 1""")(
    lambda spark, root: spread_and_second(_t(spark, root, "lineitem"), "l_suppkey", F.col("l_quantity").cast("bigint")))
