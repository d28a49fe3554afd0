"""Data checks over the given tables and over built marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import keys as K
from granary.operators import quality as Q
from granary.plans.duck import with_
from granary.plans.modelling import DIM_USERS, dim_users
from granary.plans.registry import query
from granary.plans.webstats import fct_user_ltv, stg_events
from granary.sources.tables import table

query("dq_unique", "select l_orderkey, count(*) as n from lineitem group by 1 having count(*)>1")(lambda spark, root: Q.unique(table(spark, root, "lineitem"), "l_orderkey"))
query("dq_not_null", with_("ga4", " select event_timestamp, user_pseudo_id from ga4 where user_id is null"))(
    lambda spark, root: Q.not_null(stg_events(spark, root), "user_id").select("event_timestamp", "user_pseudo_id"))
query("dq_accepted_values", "select event_type, count(*) as n from events where event_type not in ('purchase','click') group by 1")(
    lambda spark, root: Q.accepted_values(table(spark, root, "events"), "event_type", ["purchase", "click"]))


def orphans(spark: SparkSession, root: str) -> DataFrame:
    """Labels of documents that are missing, and orders without lines."""
    labels = Q.relationships(table(spark, root, "labels"), "doc_id", table(spark, root, "documents"), "doc_id").select(F.lit("label").alias("kind"), F.col("doc_id").alias("id"))
    orders = Q.relationships(table(spark, root, "orders"), "o_orderkey", table(spark, root, "lineitem"), "l_orderkey").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"))
    return labels.unionByName(orders)


query("dq_relationships", """select 'label' as kind, doc_id as id from labels where doc_id not in (select doc_id from documents)
  union all select 'order', o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)""")(orphans)
query("dq_unique_combination", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1,2 having count(*)>1")(
    lambda spark, root: Q.unique_combination(table(spark, root, "lineitem"), ["l_orderkey", "l_linenumber"]))


def declared(spark: SparkSession, root: str) -> DataFrame:
    """What breaks the keys declared for orders (sound) and for lines (their order alone is no key; suppliers as parents of part keys leave orphans)."""
    orders = K.declare_foreign(K.declare_primary(table(spark, root, "orders"), "o_orderkey"), "o_custkey", "customer", "c_custkey")
    lines = K.declare_foreign(K.declare_primary(table(spark, root, "lineitem"), "l_orderkey"), "l_partkey", "supplier", "s_suppkey")
    parents = {"customer": table(spark, root, "customer"), "supplier": table(spark, root, "supplier")}
    return K.violations(orders, parents).unionByName(K.violations(lines, parents))


query("dq_declared_keys", """select 'primary' as rule, '{"o_orderkey":'||o_orderkey||'}' as value, count(*) as n from orders group by o_orderkey having count(*)>1
  union all select 'foreign o_custkey', '{"o_custkey":'||o_custkey||'}', count(*) from orders where o_custkey not in (select c_custkey from customer) group by o_custkey
  union all select 'primary', '{"l_orderkey":'||l_orderkey||'}', count(*) from lineitem group by l_orderkey having count(*)>1
  union all select 'foreign l_partkey', '{"l_partkey":'||l_partkey||'}', count(*) from lineitem where l_partkey not in (select s_suppkey from supplier) group by l_partkey""")(declared)


def ltv_below(spark: SparkSession, root: str) -> DataFrame:
    """Days on which the lifetime value does not exceed 100."""
    return Q.expression(fct_user_ltv(spark, root), "cumulative_ltv > 100").select("event_date", "user_pseudo_id", "cumulative_ltv")


query("dq_expression", with_("ga4", """, d as (select event_date, user_pseudo_id, sum(ecommerce_purchase_revenue) as r from ga4 where ecommerce_purchase_revenue is not null group by 1,2),
c as (select event_date, user_pseudo_id, cast(sum(r) over (partition by user_pseudo_id order by event_date rows unbounded preceding) as decimal(28,2)) as cumulative_ltv from d)
select * from c where not coalesce(cumulative_ltv>100,false)"""))(ltv_below)


def differences(spark: SparkSession, root: str) -> DataFrame:
    """Lines against a copy in which returned lines lost their flag."""
    li = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    changed = li.withColumn("l_returnflag", F.when(F.col("l_returnflag") == "R", "X").otherwise(F.col("l_returnflag")))
    return Q.difference(li, changed)


query("dq_unit_case", """select l_orderkey, l_linenumber, l_returnflag, count(*) as surplus from lineitem where l_returnflag='R' group by 1,2,3
  union all select l_orderkey, l_linenumber, 'X', -count(*) from lineitem where l_returnflag='R' group by 1,2""")(differences)


def history_problems(spark: SparkSession, root: str) -> DataFrame:
    """The user history with every tablet version's end moved by an hour; the check finds them."""
    hour = F.expr("interval 1 hour")
    d = dim_users(spark, root)
    broken = d.withColumn("valid_to", F.when((F.col("device_category") == "tablet") & ~F.col("is_current"), F.col("valid_to") + hour).otherwise(F.col("valid_to")))
    return Q.scd2_integrity(broken, "visitor_id")


query("dq_scd2_integrity", with_("visits", DIM_USERS + " select visitor_id, valid_from as at, 'overlap' as problem from d where device_category='tablet' and not is_current"))(history_problems)
query("dq_schema_contract", "select * from customer")(lambda spark, root: Q.schema_contract(
    table(spark, root, "customer"), "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"))
