"""Sources and sinks, each exercised by a round trip of a given table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.plans.duck import with_
from granary.plans.registry import query
from granary.sources import adapters as A
from granary.sources import sinks
from granary.sources.tables import (
    date_spine_of, materialise, new_path, number_spine, read_dirty_csv, read_seed, read_shards, table,
)

query("src_table", "select * from orders")(lambda spark, root: table(spark, root, "orders"))

CUSTOMER_DDL = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def csv_seed(spark: SparkSession, root: str) -> DataFrame:
    path = sinks.write_csv(table(spark, root, "customer"), new_path(spark, "seed"))
    return read_seed(spark, path, CUSTOMER_DDL)


query("src_csv_seed", "select * from customer")(csv_seed)


def csv_load(spark: SparkSession, root: str) -> DataFrame:
    """CSV with a header into a table, replacing what was there."""
    rows = table(spark, root, "customer").selectExpr(
        "c_custkey as user_id", "c_name as name", "date_add(date'1970-01-01', cast(c_custkey % 10000 as int)) as birthday",
        "cast(c_custkey % 2 as bigint) as gender", "c_mktsegment as prefecture", "date'2020-01-01' as register_date", "c_custkey % 3 = 0 as is_premium")
    path = sinks.write_csv(rows, new_path(spark, "load"))
    ddl = "user_id bigint, name string, birthday date, gender bigint, prefecture string, register_date date, is_premium boolean"
    target = new_path(spark, "customers")
    sinks.write_table(read_seed(spark, path, ddl).limit(0), target)
    return sinks.write_table(read_seed(spark, path, ddl), target)


query("src_csv_load", """select c_custkey as user_id, c_name as name, date '1970-01-01'+cast(c_custkey%10000 as integer) as birthday, c_custkey%2 as gender,
  c_mktsegment as prefecture, date '2020-01-01' as register_date, c_custkey%3=0 as is_premium from customer""")(csv_load)


def csv_dirty(spark: SparkSession, root: str) -> DataFrame:
    path = new_path(spark, "dirty")
    table(spark, root, "customer").selectExpr(
        "concat(c_custkey, ',', c_name, ';,', c_nationkey, ',', c_acctbal, ',', c_mktsegment, ';') as value").write.text(path)
    return read_dirty_csv(spark, path, CUSTOMER_DDL)


query("src_csv_dirty", "select * from customer")(csv_dirty)


def query_to_table(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.countDistinct("o_custkey").alias("customers"))
    return sinks.write_table(rows, new_path(spark, "report"))


query("sink_query_to_table", "select cast(year(o_orderdate) as integer) as year, count(distinct o_custkey) as customers from orders group by 1")(query_to_table)


def csv_gz(spark: SparkSession, root: str) -> DataFrame:
    path = sinks.write_csv(table(spark, root, "customer"), new_path(spark, "extract"), gzip=True)
    return read_seed(spark, path, CUSTOMER_DDL, pathGlobFilter="*.csv.gz")


query("sink_csv_gz", "select * from customer")(csv_gz)


def empty_table(spark: SparkSession, root: str) -> DataFrame:
    """An empty table with the columns of the orders, then filled by an append."""
    orders = table(spark, root, "orders")
    path = new_path(spark, "empty")
    empty = sinks.write_empty(spark, orders.schema, path)
    orders.write.mode("append").parquet(path)
    return spark.read.schema(empty.schema).parquet(path)


query("sink_empty_table", "select * from orders")(empty_table)


def sharded(spark: SparkSession, root: str) -> DataFrame:
    """Visits kept in date shards; a pattern on the shard chooses half a month."""
    visits = A.ga_sessions(spark, root)
    path = new_path(spark, "shards")
    sinks.overwrite_partitions(visits, path, "dt")
    shards = read_shards(spark, path, visits.schema, pattern="^202401(0[1-9]|1[0-5])$")
    return shards.groupBy("dt").agg(F.countDistinct("fullVisitorId").alias("visitors"), F.sum("totals.hits").alias("hits"))


query("src_sharded", with_("visits", """ select dt, count(distinct visitor_id) as visitors, cast(sum(hits) as bigint) as hits from visits
  where dt between '20240101' and '20240115' group by 1"""))(sharded)


def spine(spark: SparkSession, root: str) -> DataFrame:
    """Every day of the order span with its number of orders."""
    o = table(spark, root, "orders")
    n = o.groupBy(F.to_date("o_orderdate").alias("date_value")).agg(F.count(F.lit(1)).alias("n_orders"))
    return date_spine_of(o, "o_orderdate").join(n, "date_value", "left").withColumn("n_orders", F.coalesce("n_orders", F.lit(0)))


query("src_date_spine", """with d as (select cast(unnest(generate_series(min(o_orderdate), max(o_orderdate), interval 1 day)) as date) as date_value from orders)
select date_value, count(o_orderkey) as n_orders from d left join orders on cast(o_orderdate as date)=date_value group by 1""")(spine)


def minutes(spark: SparkSession, root: str) -> DataFrame:
    """Minutes 0..59 with the events that fell on them."""
    n = table(spark, root, "events").groupBy(F.minute("ts").alias("minute_value")).agg(F.count(F.lit(1)).alias("n_events"))
    return number_spine(spark, 0, 59, "minute_value").join(n, "minute_value", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))


query("src_number_spine", """select cast(m.range as integer) as minute_value, count(ts) as n_events from range(60) m left join events on minute(ts)=m.range group by 1""")(minutes)


def text_lines(spark: SparkSession, root: str) -> DataFrame:
    """Texts written as files, read back by extension and counted by line."""
    path = new_path(spark, "text")
    table(spark, root, "documents").select("text").write.option("lineSep", "\n").text(path)
    lines = spark.read.option("pathGlobFilter", "*.txt").option("lineSep", "\n").text(path)
    return lines.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("value") == "").alias("n_empty"))


query("src_text_lines", """select count(*) as n_lines, count(*) filter (where l='') as n_empty from (select unnest(string_split(text, chr(10))) as l from documents) q""")(text_lines)


def insert_overwrite(spark: SparkSession, root: str) -> DataFrame:
    """Daily totals; a second batch replaces the second half of the month only."""
    e = table(spark, root, "events")
    path = new_path(spark, "daily")

    def totals(df: DataFrame, run: int) -> DataFrame:
        return df.groupBy(F.date_format("ts", "yyyyMMdd").alias("dt")).agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(run).alias("run"), "dt")

    first = totals(e, 1)
    sinks.overwrite_partitions(first, path, "dt")
    sinks.overwrite_partitions(totals(e.where(F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")), 2), path, "dt")
    return read_shards(spark, path, first.schema)


query("sink_insert_overwrite", """select strftime(ts,'%Y%m%d') as dt, count(*) as n, case when min(ts)>=timestamp '2024-01-16' then 2 else 1 end as run from events group by 1""")(insert_overwrite)


def merge_upsert(spark: SparkSession, root: str) -> DataFrame:
    """Customers, with every third replaced and as many new ones added."""
    c = table(spark, root, "customer").select("c_custkey", "c_name")
    third = c.where("c_custkey % 3 = 0")
    batch = third.selectExpr("c_custkey", "upper(c_name) as c_name").unionByName(third.selectExpr("-1 - c_custkey as c_custkey", "c_name"))
    return sinks.upsert(materialise(c, "state"), batch, "c_custkey")


query("sink_merge_upsert", """select c_custkey, case when c_custkey%3=0 then upper(c_name) else c_name end as c_name from customer
  union all select -1-c_custkey, c_name from customer where c_custkey%3=0""")(merge_upsert)
