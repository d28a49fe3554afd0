"""Sorts, limits, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.operators import vault as dv
from granary.plans.registry import query
from granary.sources.tables import table

query("sort_total", "select o_orderkey, o_orderdate, o_totalprice from orders order by o_orderdate, o_totalprice desc, o_orderkey")(
    lambda spark, root: table(spark, root, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy("o_orderdate", F.desc("o_totalprice"), "o_orderkey"))
# Priorities in the order of a report.
LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def custom_level(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    level = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("o_orderpriority"))
    return n.orderBy(level, "o_orderstatus")


query("sort_custom_level", "select o_orderpriority, o_orderstatus, count(*) as n from orders group by 1,2")(custom_level)
query("limit_n", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50")(
    lambda spark, root: table(spark, root, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50))


def topk(spark: SparkSession, root: str) -> DataFrame:
    """The three languages with most text per source, with their share.

    The window runs on one row per source and language.
    """
    n = table(spark, root, "documents").groupBy("source", "lang").agg(F.sum("n_chars").alias("chars"))
    w = W.partitionBy("source")
    ranked = n.withColumns({"rn": F.row_number().over(w.orderBy(F.desc("chars"), "lang")), "share": F.col("chars").cast("double") / F.sum("chars").over(w)})
    return ranked.where("rn <= 3")


query("topk_per_group", """select source, lang, chars, cast(rn as integer) as rn, share from (select *, row_number() over (partition by source order by chars desc, lang) as rn,
  cast(chars as double)/sum(chars) over (partition by source) as share from (select source, lang, cast(sum(n_chars) as bigint) as chars from documents group by 1,2) a) b where rn<=3""")(topk)


def union_all(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "customer").selectExpr("'customer' as kind", "c_custkey as id", "c_nationkey as nationkey")
    s = table(spark, root, "supplier").selectExpr("'supplier' as kind", "s_suppkey as id", "s_nationkey as nationkey")
    return c.unionByName(s)


query("set_union_all", "select 'customer' as kind, c_custkey as id, c_nationkey as nationkey from customer union all select 'supplier', s_suppkey, s_nationkey from supplier")(union_all)
query("set_union_distinct", "select c_nationkey as nationkey, c_custkey as id from customer union select s_nationkey, s_suppkey from supplier")(
    lambda spark, root: union_all(spark, root).select("nationkey", "id").distinct())


def multi_source(spark: SparkSession, root: str) -> DataFrame:
    """Nation keys seen by customers or suppliers; the first source in name order wins."""
    c = table(spark, root, "customer").selectExpr("c_nationkey as nation_key", "date'2020-01-02' as load_date", "'CUSTOMER' as record_source")
    s = table(spark, root, "supplier").selectExpr("s_nationkey as nation_key", "date'2020-01-01' as load_date", "'SUPPLIER' as record_source")
    hashed = {"nation_pk": ["nation_key"]}
    return dv.hub([dv.stage(c, {}, hashed), dv.stage(s, {}, hashed)], "nation_pk", "nation_key")


query("set_multi_source_union", """select md5(cast(k as varchar)) as nation_pk, k as nation_key, case when s then date '2020-01-01' else date '2020-01-02' end as load_date,
  case when s then 'SUPPLIER' else 'CUSTOMER' end as record_source from (
  select k, bool_or(s) as s from (select c_nationkey as k, false as s from customer union all select s_nationkey, true from supplier) a group by 1) b""")(multi_source)
