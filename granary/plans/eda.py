"""Exploratory reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.values import exact_avg, money
from granary.operators.joins import explore
from granary.plans.duck import with_
from granary.plans.modelling import DIM_USERS, dim_users, fct_visits, visits
from granary.plans.registry import query
from granary.sources.tables import table


def visits_by_continent(spark: SparkSession, root: str) -> DataFrame:
    d = dim_users(spark, root).select("user_sk", "continent", "sub_continent")
    return (
        fct_visits(spark, root).join(d, "user_sk").groupBy("continent", "sub_continent")
        .agg(F.sum("visits").alias("visit_num"), F.sum("hits").alias("hit_num")).orderBy(F.desc("visit_num"), F.desc("hit_num"))
    )


_VALID = "v.visitor_id=d.visitor_id and v.access_timestamp between d.valid_from and d.valid_to"
query("eda_visits_by_continent", with_("visits", DIM_USERS + f""" select d.continent, d.sub_continent, cast(sum(visits) as bigint) as visit_num,
  cast(sum(hits) as bigint) as hit_num from visits v join d on {_VALID} group by 1,2"""))(visits_by_continent)


def eda_counts(spark: SparkSession, root: str) -> DataFrame:
    """Dimension rows, current rows, fact rows and distinct visitors of a shard range, as one row each."""
    d = dim_users(spark, root)
    v = visits(spark, root)
    # One aggregate per table; its figures then become rows.
    dims = d.agg(F.count(F.lit(1)).alias("dim_rows"), F.count_if("is_current").alias("current_rows"), F.count_if(F.col("visitor_id") == "1").alias("rows_of_visitor_1"))
    facts = v.agg(F.count(F.lit(1)).alias("fact_rows"), F.countDistinct(F.when(F.col("dt").rlike("^202401(0[1-9]|1[0-5])$"), F.col("visitor_id"))).alias("visitors_in_range"))
    return dims.unpivot([], dims.columns, "metric", "n").unionByName(facts.unpivot([], facts.columns, "metric", "n"))


query("eda_counts", with_("visits", DIM_USERS + """ select 'dim_rows' as metric, count(*) as n from d union all select 'current_rows', count(*) from d where is_current
  union all select 'rows_of_visitor_1', count(*) from d where visitor_id='1' union all select 'fact_rows', count(*) from visits
  union all select 'visitors_in_range', count(distinct visitor_id) from visits where regexp_matches(dt, '^202401(0[1-9]|1[0-5])$')"""))(eda_counts)


def looker_explore(spark: SparkSession, root: str) -> DataFrame:
    """Explore: orders with customers and nations; nation and full name by month; counts and sums."""
    o, c, n = (table(spark, root, t) for t in ("orders", "customer", "nation"))
    return explore(
        o, [(c, o.o_custkey == c.c_custkey, "left"), (n, F.col("c_nationkey") == F.col("n_nationkey"), "left")],
        {"order_month": F.trunc(F.to_date("o_orderdate"), "month"), "nation": F.col("n_name"),
         "label": F.concat(F.col("n_name"), F.lit(" "), F.col("c_mktsegment"))},
        {"count": F.count(F.lit(1)), "total_price": F.sum(money("o_totalprice")).cast("decimal(28,2)")},
    )


query("looker_explore", """select cast(date_trunc('month', o_orderdate) as date) as order_month, n_name as nation, n_name||' '||c_mktsegment as label, count(*) as count,
  cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(28,2)) as total_price from orders left join customer on o_custkey=c_custkey
  left join nation on c_nationkey=n_nationkey group by 1,2,3""")(looker_explore)


def repo_activity(spark: SparkSession, root: str) -> DataFrame:
    """Events per user, last time, mean seconds between updates.

    The gaps between n ordered times add up to last - first, so no window is needed.
    """
    e = table(spark, root, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    span = F.timestamp_diff("MICROSECOND", F.col("first_ts"), F.col("last_ts"))
    return e.select("user_id", "n_events", "last_ts", (exact_avg(span, F.col("n_events") - 1) / 1e6).alias("mean_gap_seconds"))


query("repo_activity", """select user_id, count(*) as n_events, max(ts) as last_ts,
  (cast(epoch_us(max(ts))-epoch_us(min(ts)) as double)/nullif(count(*)-1,0))/1e6 as mean_gap_seconds from events group by 1""")(repo_activity)


def space_tab_ratio(spark: SparkSession, root: str) -> DataFrame:
    """Share of spaces and tabs among the characters of each language's texts."""
    count = lambda ch: F.sum(F.length("text") - F.length(F.replace(F.col("text"), F.lit(ch), F.lit(""))))
    d = table(spark, root, "documents").groupBy("lang").agg(
        count(" ").alias("spaces"), count("\t").alias("tabs"), F.sum(F.length("text")).alias("chars"))
    return d.withColumns({"space_ratio": exact_avg(F.col("spaces"), F.col("chars")), "tab_ratio": exact_avg(F.col("tabs"), F.col("chars"))})


query("space_tab_ratio", """select *, cast(spaces as double)/chars as space_ratio, cast(tabs as double)/chars as tab_ratio from (
  select lang, cast(sum(length(text)-length(replace(text,' ',''))) as bigint) as spaces, cast(sum(length(text)-length(replace(text,chr(9),''))) as bigint) as tabs,
    cast(sum(length(text)) as bigint) as chars from documents group by 1) q""")(space_tab_ratio)


def ext_stats(spark: SparkSession, root: str) -> DataFrame:
    """Pages by first path part and by file extension (empty when there is none)."""
    path = F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    p = table(spark, root, "pages").select(path.alias("path"))
    return p.groupBy(
        F.regexp_extract("path", r"^/([^/]*)", 1).alias("part"), F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1).alias("extension")
    ).agg(F.count(F.lit(1)).alias("n_pages"))


query("ext_stats", r"""select regexp_extract(path,'^/([^/]*)',1) as part, regexp_extract(path,'\.([A-Za-z0-9]+)$',1) as extension, count(*) as n_pages
  from (select regexp_extract(url,'^https?://[^/?#]+([^?#]*)',1) as path from pages) p group by 1,2""")(ext_stats)


def trend_by_period(spark: SparkSession, root: str) -> DataFrame:
    """Event counts by day, week, month and year; the coarser levels add up the days."""
    days = table(spark, root, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    levels = F.array(*[F.struct(F.lit(p).alias("period"), F.trunc("day", p).alias("start") if p != "day" else F.col("day").alias("start"))
                       for p in ("day", "week", "month", "year")])
    return days.select(F.explode(levels).alias("l"), "n").groupBy("l.period", "l.start").agg(F.sum("n").alias("n_events"))


query("trend_by_period", " union all ".join(
    f"select '{p}' as period, cast(date_trunc('{p}', ts) as date) as start, count(*) as n_events from events group by 2" for p in ("day", "week", "month", "year")))(trend_by_period)
