"""Calendar and time-of-day dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import clock, dates
from granary.sources.tables import date_spine, number_spine


def calendar(spark: SparkSession, start, end) -> DataFrame:
    """Calendar dimension, one row per day from start to end inclusive."""
    return calendar_of(date_spine(spark, start, end))


def calendar_of(days: DataFrame) -> DataFrame:
    """Calendar columns for a table of days in `date_value`."""
    d = F.col("date_value")
    month, dow = F.month(d), F.dayofweek(d)
    quarter = dates.quarter_start(d)
    return days.select(
        dates.date_int(d).alias("calendar_sk"),
        d,
        F.year(d).alias("year_value"),
        month.alias("month_value"),
        F.dayofmonth(d).alias("day_value"),
        F.quarter(d).alias("quarter_value"),
        dates.week_from_sunday(d).alias("week_of_year"),
        dow.alias("day_of_week"),
        F.dayofyear(d).alias("day_of_year"),
        F.date_format(d, "MMMM").alias("month_name_en"),
        F.date_format(d, "MMM").alias("month_name_short_en"),
        dates.pick(dates.MONTHS_JP, month).alias("month_name_jp"),
        F.date_format(d, "EEEE").alias("day_name_en"),
        F.date_format(d, "E").alias("day_name_short_en"),
        dates.pick(dates.DAYS_JP, dow).alias("day_name_jp"),
        dates.pick(dates.DAYS_SHORT_JP, dow).alias("day_name_short_jp"),
        dow.isin(1, 7).alias("is_weekend"),
        (~dow.isin(1, 7)).alias("is_weekday"),
        (F.dayofmonth(d) == 1).alias("is_first_day_of_month"),
        (d == F.last_day(d)).alias("is_last_day_of_month"),
        (d == quarter).alias("is_first_day_of_quarter"),
        (d == F.date_sub(F.add_months(quarter, 3), 1)).alias("is_last_day_of_quarter"),
        (F.dayofyear(d) == 1).alias("is_first_day_of_year"),
        ((month == 12) & (F.dayofmonth(d) == 31)).alias("is_last_day_of_year"),
        F.weekofyear(d).alias("iso_week_of_year"),
        dates.iso_year(d).alias("iso_year"),
        dates.fiscal_year(d).alias("fiscal_year_jp"),
        dates.fiscal_quarter(d).alias("fiscal_quarter_jp"),
        dates.date_int(d).alias("date_int"),
        dates.month_int(d).alias("year_month_int"),
        dates.quarter_int(d).alias("year_quarter_int"),
        F.date_sub(d, 1).alias("previous_date"),
        F.date_add(d, 1).alias("next_date"),
        F.date_sub(d, 7).alias("same_day_previous_week"),
        F.date_add(d, 7).alias("same_day_next_week"),
        F.add_months(d, -1).alias("same_day_previous_month"),
        F.add_months(d, 1).alias("same_day_next_month"),
        F.add_months(d, -12).alias("same_day_previous_year"),
        F.add_months(d, 12).alias("same_day_next_year"),
        F.dayofmonth(F.last_day(d)).alias("days_in_month"),
        dates.is_leap(d).alias("is_leap_year"),
    )


def time_of_day(spark: SparkSession) -> DataFrame:
    """Minute-of-day dimension, 1,440 rows."""
    minutes = number_spine(spark, 0, 1439, "minute_of_day")
    h = F.col("hour_value")
    m = F.col("minute_value")
    md = F.col("minute_of_day")
    spine = minutes.select(
        "minute_of_day", F.floor(md / 60).cast("int").alias("hour_value"), (md % 60).cast("int").alias("minute_value")
    )
    rush = clock.within(h, clock.MORNING_RUSH) | clock.within(h, clock.EVENING_RUSH)
    return spine.select(
        (h * 100 + m).alias("time_sk"),
        h,
        m,
        md,
        (md * 60).alias("second_of_day"),
        clock.hhmm(h, m).alias("time_24h"),
        F.concat(clock.hhmm(h, m), F.lit(":00")).alias("time_24h_full"),
        clock.hour12(h).alias("hour_12h"),
        F.concat_ws(" ", clock.hhmm(clock.hour12(h), m), clock.am_pm(h)).alias("time_12h"),
        clock.am_pm(h).alias("am_pm"),
        clock.am_pm(h, "午前", "午後").alias("am_pm_jp"),
        clock.band(h, clock.PERIODS, 2).alias("time_period_en"),
        clock.band(h, clock.PERIODS, 3).alias("time_period_jp"),
        clock.band(h, clock.SIMPLE_PERIODS, 2).alias("time_period_simple_en"),
        clock.band(h, clock.SIMPLE_PERIODS, 3).alias("time_period_simple_jp"),
        clock.within(h, clock.BUSINESS_HOURS).alias("is_business_hours"),
        clock.within(h, clock.MORNING_RUSH).alias("is_morning_rush"),
        clock.within(h, clock.EVENING_RUSH).alias("is_evening_rush"),
        rush.alias("is_rush_hour"),
        clock.group_of(m, 15).alias("quarter_hour"),
        clock.group_label(m, 15).alias("quarter_hour_label"),
        clock.group_of(m, 30).alias("half_hour"),
        clock.group_label(m, 30).alias("half_hour_label"),
        clock.within(h, clock.BREAKFAST).alias("is_breakfast_time"),
        clock.within(h, clock.LUNCH).alias("is_lunch_time"),
        clock.within(h, clock.DINNER).alias("is_dinner_time"),
        (h * 100 + m).alias("time_int"),
        clock.shifted_hhmm(md, 1).alias("next_minute"),
        clock.shifted_hhmm(md, -1).alias("previous_minute"),
        (F.floor(h / 6) + 1).cast("int").alias("time_period_id"),
        clock.group_of(m, 5).alias("five_minute_group"),
        clock.group_span(h, m, 5).alias("five_minute_label"),
        clock.group_of(m, 10).alias("ten_minute_group"),
        clock.group_span(h, m, 10).alias("ten_minute_label"),
    )
