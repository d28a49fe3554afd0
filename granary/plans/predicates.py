"""Projections and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.ordered import keyed_shift, qualify
from granary.plans.duck import with_
from granary.plans.modelling import visits
from granary.plans.registry import query
from granary.plans.webstats import stg_events
from granary.sources import adapters as A
from granary.sources.tables import table

query("proj_star_except", "select * exclude (o_orderpriority) from orders")(lambda spark, root: table(spark, root, "orders").drop("o_orderpriority"))


def on_day(df: DataFrame, ts: str, day: str | None) -> DataFrame:
    """Rows of one run date; all rows when no date is given (backfill).

    The test is a range on the bare column, so it is pushed into the scan.
    """
    if day is None:
        return df
    start = F.lit(day).cast("timestamp_ntz")
    return df.where((F.col(ts) >= start) & (F.col(ts) < start + F.expr("interval 1 day")))


def search(df: DataFrame, text: str, keyword: str | None = None, equals: dict[str, object] | None = None) -> DataFrame:
    """Optional predicates: each applies only when it is given."""
    for name, value in (equals or {}).items():
        df = df.where(F.col(name) == value)
    return df if keyword is None else df.where(F.contains(F.col(text), F.lit(keyword)))


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row with a given id, or no row."""
    return df.where(F.col(key) == value)


_FLAT = ["event_timestamp", "device_category", "device_os", "device_browser", "device_language", "geo_continent", "geo_country", "app_id", "ecommerce_transaction_id"]
query("stg_flatten_struct", with_("ga4", f" select {', '.join(_FLAT)} from ga4"))(lambda spark, root: stg_events(spark, root).select(*_FLAT))
query("proj_struct_not_null_flag", with_("visits", " select visit_id, is_new_visits from visits"))(
    lambda spark, root: A.ga_sessions(spark, root).selectExpr("visitId as visit_id", "totals.newVisits is not null as is_new_visits"))
query("filter_date_var", "select * from events where cast(ts as date) = date '2024-01-15'")(
    lambda spark, root: on_day(table(spark, root, "events"), "ts", "2024-01-15"))


def between_range(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events")
    start, stop = F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-21").cast("timestamp_ntz")
    return e.where((F.col("ts") >= start) & (F.col("ts") < stop) & F.hour("ts").between(9, 17)).select("event_id", "ts")


query("filter_between_range", "select event_id, ts from events where cast(ts as date) between date '2024-01-05' and date '2024-01-20' and hour(ts) between 9 and 17")(between_range)
query("filter_in_list", "select o_orderkey, o_orderpriority, o_orderstatus from orders where o_orderpriority in ('1-URGENT','2-HIGH') and o_orderstatus not in ('P')")(
    lambda spark, root: table(spark, root, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("P"))
    .select("o_orderkey", "o_orderpriority", "o_orderstatus"))


def year_between(spark: SparkSession, root: str) -> DataFrame:
    """Distinct customers of the years 1996 to 1999. Whole years are a range of dates, which prunes the scan."""
    start, stop = F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("2000-01-01").cast("timestamp_ntz")
    o = table(spark, root, "orders").where((F.col("o_orderdate") >= start) & (F.col("o_orderdate") < stop))
    return o.agg(F.countDistinct("o_custkey").alias("customers"))


query("filter_format_year_between", "select count(distinct o_custkey) as customers from orders where strftime(o_orderdate,'%Y') between '1996' and '1999'")(year_between)
query("filter_regex", "select page_id, url, regexp_matches(url, '/(en|fr)/[0-9]+') as is_in_range from pages")(
    lambda spark, root: table(spark, root, "pages").select("page_id", "url", F.col("url").rlike("/(en|fr)/[0-9]+").alias("is_in_range")))
query("filter_like_optional", "select doc_id, lang, source from documents where lang='en' and text like '%the%'")(
    lambda spark, root: search(table(spark, root, "documents"), "text", "the", {"lang": "en"}).select("doc_id", "lang", "source"))


def null_guard(spark: SparkSession, root: str) -> DataFrame:
    return stg_events(spark, root).where(F.col("user_id").isNotNull() & (F.col("app_id").isNotNull() | F.col("geo_city").isNotNull())).select(
        "event_timestamp", "user_id", "app_id", "geo_city")


query("filter_null_guard", with_("ga4", " select event_timestamp, user_id, app_id, geo_city from ga4 where user_id is not null and (app_id is not null or geo_city is not null)"))(null_guard)


def qualify_change(spark: SparkSession, root: str) -> DataFrame:
    """Visits whose device differs from the visitor's visit before."""
    v = visits(spark, root, False).select("visit_id", "visitor_id", "access_timestamp", "device_category")
    shifted = keyed_shift(v, "visitor_id", [F.col("access_timestamp"), F.col("visit_id")], {"before": F.col("device_category")})
    return qualify(shifted, {"__changed": F.col("before").isNull() | (F.col("before") != F.col("device_category"))}, "__changed").drop("before")


query("filter_qualify", with_("visits", """ select visit_id, visitor_id, access_timestamp, device_category from (select *, lag(device_category) over (
  partition by visitor_id order by access_timestamp, visit_id) as b from visits) q where b is null or b<>device_category"""))(qualify_change)
query("filter_point_lookup", "select * from customer where c_custkey = 42")(lambda spark, root: lookup(table(spark, root, "customer"), "c_custkey", 42))
query("filter_hour", "select event_id, ts from events where hour(ts) = 17")(
    lambda spark, root: table(spark, root, "events").where(F.hour("ts") == 17).select("event_id", "ts"))


def find_value(df: DataFrame, value: Column, position: Column) -> DataFrame:
    """Does it occur, at which last position, how often: one aggregate, no shuffle of rows."""
    return df.agg(F.coalesce(F.bool_or(value), F.lit(False)).alias("found"), F.max(F.when(value, position)).alias("last_position"), F.count_if(value).alias("n_found"))


query("exists_value", "select coalesce(bool_or(l_quantity=7),false) as found, max(case when l_quantity=7 then l_orderkey end) as last_position, count(*) filter (where l_quantity=7) as n_found from lineitem")(
    lambda spark, root: find_value(table(spark, root, "lineitem"), F.col("l_quantity") == 7, F.col("l_orderkey")))
