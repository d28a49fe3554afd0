"""Calendar and clock dimensions, counted against the tables that use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import dims
from granary.plans.registry import query
from granary.sources.tables import date_spine_of, table

JP_MONTH = "month(d)||'月'"
JP_DAY = "substr('日月火水木金土', cast(dayofweek(d) as integer)+1, 1)"

# Check twin of the calendar columns over a table of days `d`.
CALENDAR_SQL = f"""select cast(strftime(d,'%Y%m%d') as integer) as calendar_sk, d as date_value, cast(year(d) as integer) as year_value,
  cast(month(d) as integer) as month_value, cast(day(d) as integer) as day_value, cast(quarter(d) as integer) as quarter_value,
  cast(strftime(d,'%U') as integer) as week_of_year, cast(dayofweek(d)+1 as integer) as day_of_week, cast(dayofyear(d) as integer) as day_of_year,
  strftime(d,'%B') as month_name_en, strftime(d,'%b') as month_name_short_en, {JP_MONTH} as month_name_jp,
  strftime(d,'%A') as day_name_en, strftime(d,'%a') as day_name_short_en, {JP_DAY}||'曜日' as day_name_jp, {JP_DAY} as day_name_short_jp,
  dayofweek(d) in (0,6) as is_weekend, dayofweek(d) not in (0,6) as is_weekday, day(d)=1 as is_first_day_of_month, d=last_day(d) as is_last_day_of_month,
  d=date_trunc('quarter',d) as is_first_day_of_quarter, month(d)%3=0 and d=last_day(d) as is_last_day_of_quarter,
  strftime(d,'%m%d')='0101' as is_first_day_of_year, strftime(d,'%m%d')='1231' as is_last_day_of_year,
  cast(week(d) as integer) as iso_week_of_year, cast(isoyear(d) as integer) as iso_year,
  cast(case when month(d)>=4 then year(d) else year(d)-1 end as integer) as fiscal_year_jp, cast(((month(d)+8)%12)//3+1 as integer) as fiscal_quarter_jp,
  cast(strftime(d,'%Y%m%d') as integer) as date_int, cast(strftime(d,'%Y%m') as integer) as year_month_int, cast(year(d)*10+quarter(d) as integer) as year_quarter_int,
  d-1 as previous_date, d+1 as next_date, d-7 as same_day_previous_week, d+7 as same_day_next_week,
  cast(d - interval 1 month as date) as same_day_previous_month, cast(d + interval 1 month as date) as same_day_next_month,
  cast(d - interval 1 year as date) as same_day_previous_year, cast(d + interval 1 year as date) as same_day_next_year,
  cast(day(last_day(d)) as integer) as days_in_month, day(last_day(make_date(year(d),2,1)))=29 as is_leap_year from days"""

# Days spanned by the orders.
ORDER_DAYS = "days as (select cast(unnest(generate_series(min(o_orderdate), max(o_orderdate), interval 1 day)) as date) as d from orders)"


def order_calendar(spark: SparkSession, root: str) -> DataFrame:
    """Calendar over the span of the order dates."""
    return dims.calendar_of(date_spine_of(table(spark, root, "orders"), "o_orderdate"))


def dim_calendar(spark: SparkSession, root: str) -> DataFrame:
    """The order calendar with the number of orders of each day."""
    per_day = table(spark, root, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n_orders"))
    joined = order_calendar(spark, root).join(per_day, F.col("date_value") == F.col("day"), "left")
    return joined.drop("day").withColumn("n_orders", F.coalesce("n_orders", F.lit(0)))


query("dim_calendar", f"""with {ORDER_DAYS}, cal as ({CALENDAR_SQL}),
n as (select cast(o_orderdate as date) as day, count(*) as c from orders group by 1)
select cal.*, coalesce(c,0) as n_orders from cal left join n on day=date_value""")(dim_calendar)


def dim_time(spark: SparkSession, root: str) -> DataFrame:
    """The minute dimension with the number of events in each minute of the day."""
    per_minute = table(spark, root, "events").groupBy((F.hour("ts") * 100 + F.minute("ts")).alias("at")).agg(F.count(F.lit(1)).alias("n_events"))
    joined = dims.time_of_day(spark).join(per_minute, F.col("time_sk") == F.col("at"), "left")
    return joined.drop("at").withColumn("n_events", F.coalesce("n_events", F.lit(0)))


TIME_SQL = """select cast(h*100+m as integer) as time_sk, h as hour_value, m as minute_value, h*60+m as minute_of_day, (h*60+m)*60 as second_of_day,
  printf('%02d:%02d',h,m) as time_24h, printf('%02d:%02d:00',h,m) as time_24h_full,
  case when h=0 then 12 when h<=12 then h else h-12 end as hour_12h,
  printf('%02d:%02d ',case when h=0 then 12 when h<=12 then h else h-12 end,m)||case when h<12 then 'AM' else 'PM' end as time_12h,
  case when h<12 then 'AM' else 'PM' end as am_pm, case when h<12 then '午前' else '午後' end as am_pm_jp,
  case when h<5 then 'Early Morning' when h<9 then 'Morning' when h<12 then 'Late Morning' when h<14 then 'Noon' when h<17 then 'Afternoon' when h<19 then 'Evening' when h<22 then 'Night' else 'Late Night' end as time_period_en,
  case when h<5 then '深夜' when h<9 then '早朝' when h<12 then '午前' when h<14 then '正午' when h<17 then '午後' when h<19 then '夕方' when h<22 then '夜' else '深夜' end as time_period_jp,
  case when h<6 then 'Night' when h<12 then 'Morning' when h<18 then 'Afternoon' else 'Evening' end as time_period_simple_en,
  case when h<6 then '深夜' when h<12 then '朝' when h<18 then '昼' else '夜' end as time_period_simple_jp,
  h>=9 and h<=17 as is_business_hours, h in (7,8,9) as is_morning_rush, h in (17,18,19) as is_evening_rush, h in (7,8,9,17,18,19) as is_rush_hour,
  m//15+1 as quarter_hour, printf('%02d-%02d',m//15*15,m//15*15+14) as quarter_hour_label, m//30+1 as half_hour, printf('%02d-%02d',m//30*30,m//30*30+29) as half_hour_label,
  h in (7,8,9) as is_breakfast_time, h in (12,13) as is_lunch_time, h in (18,19,20) as is_dinner_time, h*100+m as time_int,
  case when h=23 and m=59 then '00:00' when m=59 then printf('%02d:00',h+1) else printf('%02d:%02d',h,m+1) end as next_minute,
  case when h=0 and m=0 then '23:59' when m=0 then printf('%02d:59',h-1) else printf('%02d:%02d',h,m-1) end as previous_minute,
  h//6+1 as time_period_id, m//5+1 as five_minute_group, printf('%02d:%02d-%02d:%02d',h,m//5*5,h,m//5*5+4) as five_minute_label,
  m//10+1 as ten_minute_group, printf('%02d:%02d-%02d:%02d',h,m//10*10,h,m//10*10+9) as ten_minute_label
from (select cast(a.range as integer) as h, cast(b.range as integer) as m from range(24) a, range(60) b) s"""

query("dim_time", f"""with t as ({TIME_SQL}), n as (select hour(ts)*100+minute(ts) as at_minute, count(*) as c from events group by 1)
select t.*, coalesce(c,0) as n_events from t left join n on at_minute=time_sk""")(dim_time)
