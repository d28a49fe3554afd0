"""Scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import clock, dates
from granary.functions.hashing import hash_diff, hash_key, sha256_base64, surrogate_key
from granary.functions.values import cents_to_dollars, first_failure, pad_right, param, twos_exponent
from granary.operators.stats import closest_pair
from granary.plans.calendar import JP_DAY, JP_MONTH
from granary.plans.duck import hash_diff as dhd
from granary.plans.duck import hash_key as dhk
from granary.plans.duck import sha_b64, surrogate, with_
from granary.plans.registry import query
from granary.plans.webstats import micros
from granary.sources import adapters as A
from granary.sources.tables import table


def _dated(spark: SparkSession, root: str, columns) -> DataFrame:
    """Order keys with date columns computed by `columns(d)`."""
    o = table(spark, root, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return o.select("o_orderkey", *[c.alias(n) for n, c in columns(F.col("d")).items()])


def _dated_sql(**columns: str) -> str:
    return "select o_orderkey, " + ", ".join(f"{e} as {n}" for n, e in columns.items()) + " from (select o_orderkey, cast(o_orderdate as date) as d from orders) o"


def _date_query(key: str, columns, **sql: str) -> None:
    query(key, _dated_sql(**sql))(lambda spark, root: _dated(spark, root, columns))


def _i(e: str) -> str:
    return f"cast({e} as integer)"


_date_query("fn_date_parts", lambda d: {"y": F.year(d), "m": F.month(d), "dd": F.dayofmonth(d), "q": F.quarter(d), "dow": F.dayofweek(d), "doy": F.dayofyear(d)},
            y=_i("year(d)"), m=_i("month(d)"), dd=_i("day(d)"), q=_i("quarter(d)"), dow=_i("dayofweek(d)+1"), doy=_i("dayofyear(d)"))
_date_query("fn_week_sunday", lambda d: {"week": dates.week_from_sunday(d)}, week=_i("strftime(d,'%U')"))
_date_query("fn_iso_week_year", lambda d: {"iso_week": F.weekofyear(d), "iso_year": dates.iso_year(d)}, iso_week=_i("week(d)"), iso_year=_i("isoyear(d)"))
_date_query("fn_date_names", lambda d: {
    "month_name": F.date_format(d, "MMMM"), "month_short": F.date_format(d, "MMM"), "day_name": F.date_format(d, "EEEE"), "day_short": F.date_format(d, "E"),
    "month_jp": dates.pick(dates.MONTHS_JP, F.month(d)), "day_jp": dates.pick(dates.DAYS_JP, F.dayofweek(d))},
    month_name="strftime(d,'%B')", month_short="strftime(d,'%b')", day_name="strftime(d,'%A')", day_short="strftime(d,'%a')", month_jp=JP_MONTH, day_jp=f"{JP_DAY}||'曜日'")
_date_query("fn_date_ints", lambda d: {"ymd": dates.date_int(d), "ym": dates.month_int(d), "yq": dates.quarter_int(d)},
            ymd=_i("strftime(d,'%Y%m%d')"), ym=_i("strftime(d,'%Y%m')"), yq=_i("year(d)*10+quarter(d)"))
_date_query("fn_date_shift", lambda d: {
    "prev_day": F.date_sub(d, 1), "next_week": F.date_add(d, 7), "prev_month": F.add_months(d, -1), "next_month": F.add_months(d, 1), "next_year": F.add_months(d, 12)},
    prev_day="d-1", next_week="d+7", prev_month="cast(d-interval 1 month as date)", next_month="cast(d+interval 1 month as date)", next_year="cast(d+interval 1 year as date)")
_date_query("fn_period_edges", lambda d: {
    "last": F.last_day(d), "is_first": F.dayofmonth(d) == 1, "is_last": d == F.last_day(d), "quarter_start": dates.quarter_start(d), "days": F.dayofmonth(F.last_day(d))},
    last="last_day(d)", is_first="day(d)=1", is_last="d=last_day(d)", quarter_start="cast(date_trunc('quarter',d) as date)", days=_i("day(last_day(d))"))
_date_query("fn_leap_fiscal", lambda d: {"leap": dates.is_leap(d), "fy": dates.fiscal_year(d), "fq": dates.fiscal_quarter(d)},
            leap="day(last_day(make_date(year(d),2,1)))=29", fy=_i("case when month(d)>=4 then year(d) else year(d)-1 end"), fq=_i("((month(d)+8)%12)//3+1"))
_date_query("fn_looker_timeframes", lambda d: {"day": d, "week": F.trunc(d, "week"), "month": F.trunc(d, "month"), "year": F.trunc(d, "year")},
            day="d", week="cast(date_trunc('week',d) as date)", month="cast(date_trunc('month',d) as date)", year="cast(date_trunc('year',d) as date)")


def date_diff(spark: SparkSession, root: str) -> DataFrame:
    li, o = table(spark, root, "lineitem"), table(spark, root, "orders")
    return li.join(o, F.expr("l_orderkey = o_orderkey")).select(
        "l_orderkey", "l_linenumber", dates.days_between(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("days"),
        F.timestamp_diff("SECOND", F.col("o_orderdate"), F.col("l_shipdate")).alias("seconds"))


query("fn_date_diff", """select l_orderkey, l_linenumber, cast(cast(l_shipdate as date)-cast(o_orderdate as date) as integer) as days, (epoch_us(l_shipdate)-epoch_us(o_orderdate))//1000000 as seconds
  from lineitem join orders on l_orderkey=o_orderkey""")(date_diff)


def epochs(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").select("event_id", dates.epoch_micros(F.col("ts")).alias("us"), F.date_format("ts", "yyyyMMdd").alias("day"))
    return e.select("event_id", F.expr(micros("us")).alias("from_micros"), dates.from_seconds(F.expr("us div 1000000")).alias("from_seconds"), F.to_date("day", "yyyyMMdd").alias("parsed"))


query("fn_epoch", "select event_id, ts as from_micros, date_trunc('second', ts) as from_seconds, cast(ts as date) as parsed from events")(epochs)
query("fn_cast_ts_to_date", "select event_id, cast(ts as date) as d from events")(
    lambda spark, root: table(spark, root, "events").select("event_id", F.to_date(F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSS"))).alias("d")))


def clock_labels(spark: SparkSession, root: str) -> DataFrame:
    h, m = F.hour("ts"), F.minute("ts")
    md = h * 60 + m
    return table(spark, root, "events").select(
        "event_id", clock.hhmm(h, m).alias("hhmm"), clock.shifted_hhmm(md, 1).alias("next_minute"), clock.shifted_hhmm(md, -1).alias("previous_minute"), clock.hour12(h).alias("h12"))


query("fn_format_pad", """select event_id, strftime(ts,'%H:%M') as hhmm, strftime(ts+interval 1 minute,'%H:%M') as next_minute, strftime(ts-interval 1 minute,'%H:%M') as previous_minute,
  cast(strftime(ts,'%I') as integer) as h12 from events""")(clock_labels)
query("fn_concat_pad", "select o_orderkey, rpad(o_orderkey||''||o_custkey||strftime(o_orderdate,'%Y%m%d'),24,'0') as number from orders")(
    lambda spark, root: table(spark, root, "orders").select("o_orderkey", pad_right(F.concat("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyyMMdd")), 24).alias("number")))
query("fn_string_concat", with_("ga4", " select event_timestamp, device_category||' '||device_language as label from ga4"))(
    lambda spark, root: A.ga4_events(spark, root).select(F.expr(micros("event_timestamp")).alias("event_timestamp"), F.concat("device.category", F.lit(" "), "device.language").alias("label")))
query("fn_edit_distance", "select p_partkey, cast(levenshtein(p_name, p_type) as integer) as distance from part")(
    lambda spark, root: table(spark, root, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance")))
query("fn_cents_to_dollars", with_("payments", " select order_id, payment_method, cast(amount/100.0 as decimal(16,2)) as dollars from payments"))(
    lambda spark, root: A.payments(spark, root).select("order_id", "payment_method", cents_to_dollars("amount").alias("dollars")))


def buckets(spark: SparkSession, root: str) -> DataFrame:
    h, m = F.hour("ts"), F.minute("ts")
    return table(spark, root, "events").select(
        "event_id", *[clock.group_of(m, w).alias(f"g{w}") for w in (5, 10, 15, 30)], clock.group_label(m, 15).alias("quarter"), clock.group_span(h, m, 10).alias("span10"))


query("fn_bucket_minutes", "select event_id, " + ", ".join(f"cast(minute(ts)//{w}+1 as integer) as g{w}" for w in (5, 10, 15, 30)) + """,
  printf('%02d-%02d',minute(ts)//15*15,minute(ts)//15*15+14) as quarter, printf('%02d:%02d-%02d:%02d',hour(ts),minute(ts)//10*10,hour(ts),minute(ts)//10*10+9) as span10 from events""")(buckets)


def bands(spark: SparkSession, root: str) -> DataFrame:
    h = F.hour("ts")
    a = F.floor(F.col("value") * 400)
    return table(spark, root, "events").select(
        "event_id", clock.band(h, clock.PERIODS, 2).alias("period"), clock.band(h, clock.SIMPLE_PERIODS, 3).alias("simple_jp"),
        clock.above(a, clock.ATTENDANCE_BANDS, clock.ATTENDANCE_REST, 1).alias("crowd"))


query("fn_case_bands", """select event_id, case when h<5 then 'Early Morning' when h<9 then 'Morning' when h<12 then 'Late Morning' when h<14 then 'Noon' when h<17 then 'Afternoon' when h<19 then 'Evening' when h<22 then 'Night' else 'Late Night' end as period,
  case when h<6 then '深夜' when h<12 then '朝' when h<18 then '昼' else '夜' end as simple_jp,
  case when a>40000 then 'Packed' when a>30000 then 'Full' when a>20000 then 'Normal' else 'Low' end as crowd from (select event_id, hour(ts) as h, floor(value*400) as a from events) q""")(bands)
query("fn_coalesce_nullif", "select p_partkey, coalesce(nullif(p_type,'ECONOMY'),'none') as kind, coalesce(nullif(p_type,'ECONOMY')='STANDARD',false) as is_standard from part")(
    lambda spark, root: table(spark, root, "part").select(
        "p_partkey", F.coalesce(F.nullif("p_type", F.lit("ECONOMY")), F.lit("none")).alias("kind"),
        F.coalesce(F.nullif("p_type", F.lit("ECONOMY")) == "STANDARD", F.lit(False)).alias("is_standard")))
query("fn_hash_sha256_b64", f"select c_custkey, {sha_b64('c_name', 'c_mktsegment', 'c_nationkey')} as h from customer")(
    lambda spark, root: table(spark, root, "customer").select("c_custkey", sha256_base64("c_name", "c_mktsegment", "c_nationkey").alias("h")))


def surrogates(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"), "c_nationkey")
    return c.select("c_custkey", surrogate_key(c, ["c_custkey", "seg", "c_nationkey"]).alias("sk"))


query("fn_surrogate_key_md5", f"select c_custkey, {surrogate('c_custkey', 'seg', 'c_nationkey')} as sk from (select *, nullif(c_mktsegment,'BUILDING') as seg from customer) c")(surrogates)


def vault_hashes(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders")
    return o.select("o_orderkey", hash_key(o, ["o_orderkey", "o_custkey"]).alias("pk"), hash_diff(o, ["o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]).alias("hd"))


query("fn_vault_hash", "select o_orderkey, " + dhk("o_orderkey", "o_custkey") + " as pk, " + dhd(
    o_orderstatus="o_orderstatus", o_totalprice="cast(o_totalprice as decimal(18,2))", o_orderdate="strftime(o_orderdate,'%Y-%m-%d %H:%M:%S')", o_orderpriority="o_orderpriority") + " as hd from orders")(vault_hashes)
query("fn_array_lookup", with_("ga4", " select event_timestamp, engagement_time_msec, ga_session_id, page_location, cast(null as bigint) as missing from ga4"))(
    lambda spark, root: A.ga4_events(spark, root).select(
        F.expr(micros("event_timestamp")).alias("event_timestamp"), param("event_params", "engagement_time_msec", "int_value").alias("engagement_time_msec"),
        param("event_params", "ga_session_id", "int_value").alias("ga_session_id"), param("event_params", "page_location", "string_value").alias("page_location"),
        param("event_params", "no_such_key", "int_value").alias("missing")))
query("fn_unnest", "select p_partkey, unnest(string_split(p_name,' ')) as word from part")(
    lambda spark, root: table(spark, root, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word")))
query("fn_json_get", "select event_id, cast(json_extract_string(props,'$.k') as bigint) as k from events")(
    lambda spark, root: table(spark, root, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k")))


def sum_numbers(df: DataFrame, token: Column) -> DataFrame:
    """Sum of the tokens that are whole numbers, and how many are not."""
    good = token.rlike("^-?[0-9]+$")
    number = F.when(good, token).try_cast("decimal(38,0)")
    return df.agg(F.sum(number).cast("decimal(38,0)").alias("total"), F.count_if(~good).alias("rejected"))


query("fn_safe_int_cast", """select cast(sum(case when regexp_matches(w,'^-?[0-9]+$') then try_cast(w as decimal(38,0)) end) as decimal(38,0)) as total,
  count(*) filter (where not regexp_matches(w,'^-?[0-9]+$')) as rejected from (select unnest(regexp_split_to_array(text,'\\s+')) as w from documents) q""")(
    lambda spark, root: sum_numbers(table(spark, root, "documents").select(F.explode(F.split("text", r"\s+")).alias("w")), F.col("w")))
query("fn_rule_first_failure", """select conv_id, turn, case when strlen(text)<8 then 'too_short' when not regexp_matches(text,'\\p{Lu}') then 'no_uppercase' when not regexp_matches(text,'\\p{Ll}') then 'no_lowercase'
  when not regexp_matches(text,'[0-9]') then 'no_digit' end as failure from conversations""")(
    lambda spark, root: table(spark, root, "conversations").select("conv_id", "turn", first_failure(F.col("text")).alias("failure")))
query("fn_pair_distance_min", """with p as (select row_number() over () as i, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y from embeddings)
select min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) as min_distance from p a join p b on a.i<b.i""")(
    lambda spark, root: closest_pair(table(spark, root, "embeddings"), F.col("embedding")[0], F.col("embedding")[1]))
query("fn_two_power_exponent", "select l_suppkey, cast(min(bit_count(((l_partkey+1) & -(l_partkey+1))-1)) as integer) as exponent from lineitem group by 1")(
    lambda spark, root: table(spark, root, "lineitem").groupBy("l_suppkey").agg(F.min(twos_exponent(F.col("l_partkey") + 1)).alias("exponent")))
