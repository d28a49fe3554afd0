"""Web-analytics staging, dimensions, daily facts, sessions and lifetime value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.hashing import surrogate_key
from granary.functions.values import floor_round, param
from granary.operators import scd
from granary.operators.joins import null_safe_join
from granary.operators.ordered import keyed_running, latest_per_key
from granary.plans.duck import fr, surrogate, with_
from granary.plans.registry import query
from granary.sources import adapters as A
from granary.sources.tables import cut_lineage

PARAMS = [("engagement_time_msec", "int_value"), ("ga_session_id", "int_value"), ("ga_session_number", "int_value"),
          ("page_location", "string_value"), ("page_title", "string_value")]


def micros(column: str) -> str:
    return f"{A.EPOCH} + make_dt_interval(0, 0, 0, cast({column} / cast(1000000 as decimal(8,0)) as decimal(18,6)))"


def stg_events(spark: SparkSession, root: str) -> DataFrame:
    """Flat events: structs and five parameters become columns."""
    raw = A.ga4_events(spark, root)
    names = ["event_date", "event_timestamp", "event_name", "user_id", "user_pseudo_id", "user_first_touch_timestamp"]
    flat = raw.select(
        F.to_date("event_date", "yyyyMMdd").alias("event_date"), F.expr(micros("event_timestamp")).alias("event_timestamp"),
        "event_name", "user_id", "user_pseudo_id", F.expr(micros("user_first_touch_timestamp")).alias("user_first_touch_timestamp"),
        F.col("device.category").alias("device_category"), F.col("device.operating_system").alias("device_os"),
        F.col("device.operating_system_version").alias("device_os_version"), F.col("device.web_info.browser").alias("device_browser"),
        F.col("device.web_info.browser_version").alias("device_browser_version"), F.col("device.language").alias("device_language"),
        F.col("device.is_limited_ad_tracking").alias("device_is_limited_ad_tracking"),
        F.col("device.mobile_brand_name").alias("device_mobile_brand_name"), F.col("device.mobile_model_name").alias("device_mobile_model_name"),
        F.col("geo.continent").alias("geo_continent"), F.col("geo.country").alias("geo_country"), F.col("geo.region").alias("geo_region"),
        F.col("geo.city").alias("geo_city"), F.col("app_info.id").alias("app_id"), F.col("app_info.version").alias("app_version"),
        F.col("app_info.firebase_app_id").alias("firebase_app_id"),
        *[param("event_params", key, field).alias(key) for key, field in PARAMS],
        F.col("ecommerce.total_item_quantity").alias("ecommerce_total_item_quantity"),
        F.col("ecommerce.purchase_revenue").alias("ecommerce_purchase_revenue"),
        F.col("ecommerce.transaction_id").alias("ecommerce_transaction_id"),
    )
    return flat.select(*names, *[c for c in flat.columns if c not in names])


query("ga4_stg_events", with_("ga4", " select * exclude (geo_sub_continent) from ga4"))(stg_events)


def thin_events(spark: SparkSession, root: str) -> DataFrame:
    """Renamed events that keep the device and geo structs."""
    return A.ga4_events(spark, root).select(
        F.expr(micros("event_timestamp")).alias("event_timestamp"), "event_name", F.col("user_pseudo_id").alias("user_id"),
        F.expr(micros("user_first_touch_timestamp")).alias("created_at"), "platform", "device", "geo",
    )


_THIN = """, thin as (select event_timestamp, event_name, user_pseudo_id as user_id, user_first_touch_timestamp as created_at, 'WEB' as platform,
  device_category as category, device_mobile_brand_name as mobile_brand_name, device_mobile_model_name as mobile_model_name, device_os as operating_system,
  device_os_version as operating_system_version, device_language, geo_continent as continent, geo_sub_continent as sub_continent, geo_country as country,
  geo_region as region, geo_city as city, cast(event_timestamp as date) as date from ga4)"""
query("ga4_stg_events_thin", with_("ga4", _THIN + " select event_timestamp, event_name, user_id, created_at, platform, category, country from thin"))(
    lambda spark, root: thin_events(spark, root).select("event_timestamp", "event_name", "user_id", "created_at", "platform", "device.category", "geo.country"))


# --- dimensions of the marts ----------------------------------------------------------


def ga4_dim_users(spark: SparkSession, root: str) -> DataFrame:
    """One row per pseudo id; an account id is kept when any event carries it."""
    return stg_events(spark, root).groupBy("user_pseudo_id").agg(
        F.max("user_id").alias("user_id"), F.min("user_first_touch_timestamp").alias("first_touch_timestamp"), F.min("event_date").alias("first_access_date"),
    )


query("ga4_dim_users", with_("ga4", """ select user_pseudo_id, max(user_id) as user_id, min(user_first_touch_timestamp) as first_touch_timestamp,
  min(event_date) as first_access_date from ga4 group by 1"""))(ga4_dim_users)


def distinct_dim(df: DataFrame, columns: list[str], key: str, present: str) -> DataFrame:
    """Distinct attribute rows with a hash key over all of them."""
    rows = df.where(present).select(*columns).distinct()
    return rows.withColumn(key, surrogate_key(rows, columns))


DEVICE = ["device_category", "device_os", "device_os_version", "device_browser", "device_browser_version", "device_language"]
GEO = ["geo_continent", "geo_country", "geo_region", "geo_city"]
APP = ["app_id", "app_version", "firebase_app_id"]
for _key, _name, _cols, _present in (
    ("ga4_dim_devices", "device_key", DEVICE, "device_category is not null"), ("ga4_dim_geo", "geo_key", GEO, "geo_country is not null"),
    ("ga4_dim_apps", "app_key", APP, "app_id is not null or firebase_app_id is not null"),
):
    query(_key, with_("ga4", f" select {surrogate(*_cols)} as {_name}, * from (select distinct {', '.join(_cols)} from ga4 where {_present}) q"))(
        lambda spark, root, name=_name, cols=_cols, present=_present: distinct_dim(stg_events(spark, root), cols, name, present))


# --- daily facts ----------------------------------------------------------------------


def fct_daily_access(spark: SparkSession, root: str) -> DataFrame:
    return stg_events(spark, root).groupBy("event_date", "user_pseudo_id").agg(
        F.count(F.lit(1)).alias("total_events"), F.countDistinct("ga_session_id").alias("total_sessions"),
        F.countDistinct("page_location").alias("unique_pages_viewed"),
    )


query("fct_daily_access", with_("ga4", """ select event_date, user_pseudo_id, count(*) as total_events, count(distinct ga_session_id) as total_sessions,
  count(distinct page_location) as unique_pages_viewed from ga4 group by 1,2"""))(fct_daily_access)


def fct_daily_engagement(spark: SparkSession, root: str) -> DataFrame:
    total = F.col("total_engagement_time_msec").cast("double")
    return (
        stg_events(spark, root).groupBy("event_date", "user_pseudo_id")
        .agg(F.sum(F.coalesce("engagement_time_msec", F.lit(0))).alias("total_engagement_time_msec"))
        .withColumns({"total_engagement_time_sec": total / 1000.0, "total_engagement_time_min": total / 1000.0 / 60.0})
    )


query("fct_daily_engagement", with_("ga4", """ select *, cast(total_engagement_time_msec as double)/1000 as total_engagement_time_sec,
  cast(total_engagement_time_msec as double)/1000/60 as total_engagement_time_min from (
  select event_date, user_pseudo_id, cast(sum(coalesce(engagement_time_msec,0)) as bigint) as total_engagement_time_msec from ga4 group by 1,2) q"""))(fct_daily_engagement)

SESSION = ["event_date", "user_pseudo_id", "ga_session_id"]


def fct_session_summary(spark: SparkSession, root: str) -> DataFrame:
    """One row per session and day: span, counts, engagement, purchase, revenue."""
    rows = stg_events(spark, root).where(F.col("ga_session_id").isNotNull()).groupBy(*SESSION).agg(
        F.min("event_timestamp").alias("session_start_time"), F.max("event_timestamp").alias("session_end_time"),
        F.count(F.lit(1)).alias("total_events"), F.countDistinct("event_name").alias("unique_event_types"),
        F.countDistinct("page_location").alias("pages_viewed"),
        F.sum(F.coalesce("engagement_time_msec", F.lit(0))).alias("total_engagement_time_msec"),
        F.max(F.when(F.col("event_name") == "purchase", 1).otherwise(0)).alias("has_purchase"),
        F.sum(F.coalesce("ecommerce_purchase_revenue", F.lit(0).cast("decimal(18,2)"))).cast("decimal(28,2)").alias("session_revenue"),
    )
    return rows.withColumns({
        "session_duration_seconds": F.timestamp_diff("SECOND", F.col("session_start_time"), F.col("session_end_time")),
        "total_engagement_time_seconds": floor_round(F.col("total_engagement_time_msec") / 1000.0, 2),
    })


query("fct_session_summary", with_("ga4", f""" select *, epoch_us(session_end_time)//1000000 - epoch_us(session_start_time)//1000000
   - case when epoch_us(session_end_time)%1000000 < epoch_us(session_start_time)%1000000 then 1 else 0 end as session_duration_seconds,
  {fr('total_engagement_time_msec/1000.0', 2)} as total_engagement_time_seconds from (
  select event_date, user_pseudo_id, ga_session_id, min(event_timestamp) as session_start_time, max(event_timestamp) as session_end_time, count(*) as total_events,
    count(distinct event_name) as unique_event_types, count(distinct page_location) as pages_viewed,
    cast(sum(coalesce(engagement_time_msec,0)) as bigint) as total_engagement_time_msec, max(case when event_name='purchase' then 1 else 0 end) as has_purchase,
    cast(sum(coalesce(ecommerce_purchase_revenue,0)) as decimal(28,2)) as session_revenue from ga4 where ga_session_id is not null group by 1,2,3) q"""))(fct_session_summary)


def fct_user_ltv(spark: SparkSession, root: str) -> DataFrame:
    """Daily revenue, running lifetime value, days since first access."""
    events = stg_events(spark, root)
    daily = events.where(F.col("ecommerce_purchase_revenue").isNotNull()).groupBy("event_date", "user_pseudo_id").agg(
        F.sum("ecommerce_purchase_revenue").cast("decimal(28,2)").alias("daily_revenue"))
    running = keyed_running(daily, "user_pseudo_id", [F.col("event_date")], {"cumulative_ltv": F.col("daily_revenue")})
    users = ga4_dim_users(spark, root).select("user_pseudo_id", "first_access_date")
    return running.join(users, "user_pseudo_id", "left").select(
        "event_date", "user_pseudo_id", "first_access_date", F.date_diff("event_date", "first_access_date").alias("days_since_first_access"),
        "daily_revenue", F.col("cumulative_ltv").cast("decimal(28,2)").alias("cumulative_ltv"),
    )


query("fct_user_ltv", with_("ga4", """, d as (select event_date, user_pseudo_id, sum(ecommerce_purchase_revenue) as r from ga4 where ecommerce_purchase_revenue is not null group by 1,2),
u as (select user_pseudo_id, min(event_date) as first_access_date from ga4 group by 1)
select d.event_date, d.user_pseudo_id, first_access_date, cast(event_date-first_access_date as integer) as days_since_first_access, cast(r as decimal(28,2)) as daily_revenue,
  cast(sum(r) over (partition by d.user_pseudo_id order by event_date rows unbounded preceding) as decimal(28,2)) as cumulative_ltv from d left join u on u.user_pseudo_id=d.user_pseudo_id"""))(fct_user_ltv)


# --- daily dimensions and access facts ------------------------------------------------

USER = ["user_id", "created_at", "platform", "category", "mobile_brand_name", "mobile_model_name", "operating_system", "operating_system_version", "device_language"]
PLACE = ["continent", "sub_continent", "country", "region", "city"]


def _flat(spark: SparkSession, root: str) -> DataFrame:
    return thin_events(spark, root).selectExpr(
        "event_timestamp", "to_date(event_timestamp) as date", "user_id", "created_at", "platform", "device.category", "device.mobile_brand_name",
        "device.mobile_model_name", "device.operating_system", "device.operating_system_version", "device.language as device_language",
        *[f"geo.{c}" for c in PLACE],
    )


def _stamp(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    return df.withColumn(key, surrogate_key(df, columns))


def dim_users_daily(spark: SparkSession, root: str, day: str | None = None) -> DataFrame:
    """Attribute set of each user and day with its last time; `day` limits to one day."""
    rows = _flat(spark, root)
    if day is not None:
        rows = rows.where(F.col("date") == F.to_date(F.lit(day)))
    return _stamp(rows.groupBy("date", *USER).agg(F.max("event_timestamp").alias("updated_at")), ["user_id", "created_at", "updated_at"], "user_key")


def dim_countries_daily(spark: SparkSession, root: str, day: str | None = None) -> DataFrame:
    rows = _flat(spark, root)
    if day is not None:
        rows = rows.where(F.col("date") == F.to_date(F.lit(day)))
    return _stamp(rows.groupBy("date", *PLACE).agg(F.max("event_timestamp").alias("updated_at")), [*PLACE, "updated_at"], "country_key")


def _ts(c: str) -> str:
    return f"strftime({c},'%Y-%m-%d %H:%M:%S')"


DAILY_SQL = _THIN + f""", du as (select {surrogate('user_id', _ts('created_at'), _ts('updated_at'))} as user_key, * from (
  select date, {', '.join(USER)}, max(event_timestamp) as updated_at from thin group by all) q),
dc as (select {surrogate(*PLACE, _ts('updated_at'))} as country_key, * from (select date, {', '.join(PLACE)}, max(event_timestamp) as updated_at from thin group by all) q)"""
query("ga4_dim_users_daily", with_("ga4", DAILY_SQL + " select * from du"))(dim_users_daily)
query("ga4_dim_countries_daily", with_("ga4", DAILY_SQL + " select * from dc"))(dim_countries_daily)


def fct_access(spark: SparkSession, root: str) -> DataFrame:
    """Events with the keys of the user and place rows of their day. Null places find no match."""
    e = _flat(spark, root).select("event_timestamp", "date", "user_id", "created_at", *PLACE)
    u = dim_users_daily(spark, root).select("user_key", "user_id", "created_at", "date")
    c = dim_countries_daily(spark, root).select("country_key", *PLACE, "date")
    return e.join(u, ["user_id", "created_at", "date"]).join(c, [*PLACE, "date"]).select(
        "user_key", "country_key", F.col("event_timestamp").alias("access_timestamp"), "event_timestamp")


_EQ = " and ".join(f"t.{c}=c.{c}" for c in PLACE)
query("ga4_fct_access", with_("ga4", DAILY_SQL + f""" select user_key, country_key, t.event_timestamp as access_timestamp, t.event_timestamp from thin t
  join du on du.user_id=t.user_id and du.created_at=t.created_at and du.date=t.date join dc c on {_EQ} and c.date=t.date"""))(fct_access)

# --- snapshots ------------------------------------------------------------------------

# The days before which a run reads; the last run reads to the end of the data.
RUNS = ("2024-01-10", "2024-01-20", None)


def user_feed(spark: SparkSession, root: str, after: str | None, upto: str | None) -> DataFrame:
    """One row per user: the last attribute set in [after, upto)."""
    f = _between(_flat(spark, root), after, upto).select(*USER, "event_timestamp")
    last = latest_per_key(f, ["user_id", "created_at"], [F.col("event_timestamp")]).withColumnRenamed("event_timestamp", "updated_at")
    return _stamp(last, ["user_id", "created_at"], "user_key")


def country_feed(spark: SparkSession, root: str, after: str | None, upto: str | None) -> DataFrame:
    f = _between(_flat(spark, root), after, upto)
    return _stamp(f.groupBy(*PLACE).agg(F.max("event_timestamp").alias("updated_at")), PLACE, "country_key")


def _between(df: DataFrame, after: str | None, upto: str | None) -> DataFrame:
    df = df if upto is None else df.where(F.col("date") < F.to_date(F.lit(upto)))
    return df if after is None else df.where(F.col("date") >= F.to_date(F.lit(after)))


def snap_countries(spark: SparkSession, root: str) -> DataFrame:
    """Places by first sight: only keys that are not stored yet are passed on."""
    state, after = None, None
    for upto in RUNS:
        batch = country_feed(spark, root, after, upto)
        if state is not None:
            batch = batch.join(state.select("country_key"), "country_key", "left_anti")
        state = cut_lineage(scd.snapshot(batch, "country_key", PLACE, upto, "timestamp", "updated_at", state))
        after = upto
    return state


def snap_users(spark: SparkSession, root: str) -> DataFrame:
    """Users: a new key, or a null-safe change of any attribute against the current row."""
    state, after = None, None
    attrs = [c for c in USER if c not in ("user_id", "created_at")]
    for upto in RUNS:
        batch = user_feed(spark, root, after, upto)
        if state is not None:
            current = state.where(F.col("valid_to").isNull()).select("user_key", *attrs)
            # Rows equal to the current row in every attribute are dropped; keys then match null-safely.
            same = null_safe_join(batch, current, ["user_key", *attrs], "left_semi").select("user_key")
            batch = batch.join(same, "user_key", "left_anti")
        state = cut_lineage(scd.snapshot(batch, "user_key", attrs, upto, "timestamp", "updated_at", state))
        after = upto
    return state


def _snap_country_sql() -> str:
    parts = []
    for i, upto in enumerate(RUNS):
        span = " and ".join(([f"date >= date '{RUNS[i - 1]}'"] if i else []) + ([f"date < date '{upto}'"] if upto else []))
        parts.append(f"select {i} as run, {', '.join(PLACE)}, max(event_timestamp) as updated_at from thin where {span} group by all")
    return _THIN + f""", fd as ({' union all '.join(parts)}),
sc as (select {surrogate(*PLACE)} as country_key, * exclude (run, rn) from (select *, row_number() over (partition by {surrogate(*PLACE)} order by run) as rn from fd) q where rn=1),
snapc as (select *, updated_at as valid_from, cast(null as timestamp) as valid_to from sc)"""


query("snap_timestamp_countries", with_("ga4", _snap_country_sql() + " select * from snapc"))(snap_countries)


def _snap_user_sql() -> str:
    attrs = [c for c in USER if c not in ("user_id", "created_at")]
    parts = []
    for i, upto in enumerate(RUNS):
        span = " and ".join(([f"date >= date '{RUNS[i - 1]}'"] if i else []) + ([f"date < date '{upto}'"] if upto else []))
        parts.append(f"""select {i} as run, * from (select {', '.join(USER)}, event_timestamp as updated_at,
          row_number() over (partition by user_id, created_at order by event_timestamp desc) as rn from thin where {span}) q where rn=1""")
    key = surrogate("user_id", _ts("created_at"))
    prev = " || '|' || ".join(f"coalesce({a},'~')" for a in attrs)
    return f""", uf as ({' union all '.join(parts)}),
uk as (select {key} as user_key, * exclude (run, rn), {prev} as sig, run from uf),
uc as (select * from (select *, lag(sig) over (partition by user_key order by run) as before from uk) q where before is null or before<>sig),
snapu as (select * exclude (sig, run, before), updated_at as valid_from, lead(updated_at) over (partition by user_key order by run) as valid_to from uc)"""


query("snap_timestamp_users", with_("ga4", _THIN + _snap_user_sql() + " select * from snapu"))(snap_users)


def fct_scd_access(spark: SparkSession, root: str, keep_null: bool = False) -> DataFrame:
    """Events of all days with the newest snapshot rows; `keep_null` lets null places match."""
    e = _flat(spark, root).select("event_timestamp", "user_id", "created_at", *PLACE)
    u = latest_per_key(snap_users(spark, root).select("user_key", "user_id", "created_at", "valid_from"), "user_key", [F.col("valid_from")])
    c = latest_per_key(snap_countries(spark, root).select("country_key", *PLACE, "valid_from"), "country_key", [F.col("valid_from")])
    e = e.join(u.drop("valid_from"), ["user_id", "created_at"])
    places = c.drop("valid_from")
    joined = null_safe_join(e, places, PLACE) if keep_null else e.join(places, PLACE)
    return joined.select("user_key", "country_key", F.col("event_timestamp").alias("access_timestamp"), "event_timestamp")


_EQN = " and ".join(f"t.{c} is not distinct from c.{c}" for c in PLACE)
_SCD_SQL = _snap_country_sql() + _snap_user_sql() + """ select u.user_key, c.country_key, t.event_timestamp as access_timestamp, t.event_timestamp from thin t
  join (select distinct user_key, user_id, created_at from snapu) u on u.user_id=t.user_id and u.created_at=t.created_at join snapc c on """
query("ga4_fct_scd_access", with_("ga4", _SCD_SQL + _EQ))(lambda spark, root: fct_scd_access(spark, root))
query("join_null_safe", with_("ga4", _SCD_SQL + _EQN))(lambda spark, root: fct_scd_access(spark, root, keep_null=True))
