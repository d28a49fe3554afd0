"""Streaming twins of batch loads and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import scd
from granary.operators import vault as dv
from granary.plans import vault as V
from granary.plans.duck import surrogate, with_
from granary.plans.modelling import ATTRS, DIM_USERS, visits
from granary.plans.registry import open_ended, query
from granary.plans.webstats import stg_events
from granary.sources.tables import table
from granary.streaming import jobs

# Days at which an arrival ends and the next one starts.
EDGES = ["2024-01-11", "2024-01-21"]


def _periods(df: DataFrame, ts: str) -> list[DataFrame]:
    """Arrivals that hold all rows: the first is open below, the last open above. Rows without a time arrive first."""
    passed = sum((F.coalesce(F.col(ts) >= F.lit(d).cast("timestamp_ntz"), F.lit(False)).cast("int") for d in EDGES), F.lit(0))
    return [df.where(passed == i) for i in range(len(EDGES) + 1)]


def stream_scd2(spark: SparkSession, root: str) -> DataFrame:
    """The user history loaded by a stream, one arrival per period."""
    rows = visits(spark, root, False).select("visitor_id", *ATTRS, "access_timestamp")

    def load(state: DataFrame | None, batch: DataFrame) -> DataFrame:
        return scd.scd2_merge(state, scd.scd2(batch, "visitor_id", ATTRS, "access_timestamp", state=state))

    return jobs.stateful_load(spark, _periods(rows, "access_timestamp"), "scd2", ["visitor_id"], load)


open_ended("stream_scd2", with_("visits", DIM_USERS + f""" select {surrogate('visitor_id', "strftime(valid_from,'%Y-%m-%d %H:%M:%S')")} as user_sk, * from d"""))(stream_scd2)


def stream_hub(spark: SparkSession, root: str) -> DataFrame:
    """The customer hub loaded by a stream, one arrival per load."""
    columns = ["customer_pk", "customerkey", "load_date", "record_source"]
    parts = [V.stage_orders(spark, root, load, ["customer_pk"]).select(*columns) for load in (1, 2)]

    def load(state: DataFrame | None, batch: DataFrame) -> DataFrame:
        return dv.append(state, dv.hub(batch, "customer_pk", "customerkey", state=state))

    return jobs.stateful_load(spark, parts, "hub", ["customer_pk"], load)


query("stream_hub_dedup", V._two_load_sql(*V.HUBS["customer"][:2], [], V.HUBS["customer"][2]))(stream_hub)

KEYS = ["user_pseudo_id", "ga_session_id", "page_location"]


def stream_daily_access(spark: SparkSession, root: str) -> DataFrame:
    """Daily access counts of every day. The last arrival repeats an early day, which is too late and dropped."""
    e = stg_events(spark, root).select("event_timestamp", *KEYS)
    parts = _periods(e, "event_timestamp")
    late = e.where(F.to_date("event_timestamp") == F.to_date(F.lit("2024-01-02")))
    parts[-1] = parts[-1].unionByName(late)
    partial = jobs.run_bounded(spark, parts, "access", "event_timestamp", "3 days", lambda s: jobs.daily_partials(s, "event_timestamp", KEYS, "1 day"))
    return partial.groupBy("event_date", "user_pseudo_id").agg(
        F.sum("n").alias("total_events"), F.countDistinct("ga_session_id").alias("total_sessions"), F.countDistinct("page_location").alias("unique_pages_viewed"))


query("stream_daily_access", with_("ga4", """ select event_date, user_pseudo_id, count(*) as total_events, count(distinct ga_session_id) as total_sessions,
  count(distinct page_location) as unique_pages_viewed from ga4 where event_timestamp is not null group by 1,2"""))(stream_daily_access)


def stream_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Sessions with a 30-minute gap, to the end of the feed."""
    e = table(spark, root, "events").select("user_id", "ts")
    return jobs.run_bounded(spark, _periods(e, "ts"), "sessions", "ts", "2 hours", lambda s: jobs.gap_sessions(s, "ts", "user_id", "30 minutes", "1 hour"))


query("stream_sessions", """with g as (select user_id, ts, case when ts < lag(ts) over w + interval 30 minute then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as sid from g)
select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as n_events from s where ts is not null group by user_id, sid""")(stream_sessions)
