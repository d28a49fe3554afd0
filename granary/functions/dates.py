"""Calendar expressions on date columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Japanese month and weekday names (weekdays from Sunday).
MONTHS_JP = ["1月", "2月", "3月", "4月", "5月", "6月", "7月", "8月", "9月", "10月", "11月", "12月"]
DAYS_JP = ["日曜日", "月曜日", "火曜日", "水曜日", "木曜日", "金曜日", "土曜日"]
DAYS_SHORT_JP = ["日", "月", "火", "水", "木", "金", "土"]
DAYS_EN = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]

# Season of a month, months 1..12.
SEASONS_EN = ["Winter", "Winter", "Spring", "Spring", "Spring", "Summer", "Summer", "Summer", "Fall", "Fall", "Fall", "Winter"]
SEASONS_JP = ["冬", "冬", "春", "春", "春", "夏", "夏", "夏", "秋", "秋", "秋", "冬"]


def pick(names: list[str], position: Column) -> Column:
    """The `position`-th (from 1) of a short fixed list."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), position.cast("int"))


def week_from_sunday(d: Column) -> Column:
    """Week of year where weeks start on Sunday and days before the first are week 0."""
    return F.floor((F.dayofyear(d) - F.dayofweek(d) + 7) / 7).cast("int")


def iso_year(d: Column) -> Column:
    # The ISO year is the calendar year of the week's Thursday.
    return F.year(F.date_add(F.date_trunc("week", d).cast("date"), 3))


def fiscal_year(d: Column, first_month: int = 4) -> Column:
    return F.year(F.add_months(d, -(first_month - 1)))


def fiscal_quarter(d: Column, first_month: int = 4) -> Column:
    return F.quarter(F.add_months(d, -(first_month - 1)))


def is_leap(d: Column) -> Column:
    return F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31))) == 366


def quarter_start(d: Column) -> Column:
    return F.trunc(d, "quarter")


def date_int(d: Column) -> Column:
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def month_int(d: Column) -> Column:
    return (F.year(d) * 100 + F.month(d)).cast("int")


def quarter_int(d: Column) -> Column:
    return (F.year(d) * 10 + F.quarter(d)).cast("int")


def days_between(later: Column, earlier: Column) -> Column:
    return F.date_diff(later, earlier)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def epoch_seconds(ts: Column) -> Column:
    return F.floor(epoch_micros(ts) / 1_000_000).cast("bigint")


def from_micros(us: Column) -> Column:
    """Zone-less timestamp of microseconds since 1970."""
    start = F.lit("1970-01-01").cast("timestamp_ntz")
    whole = F.make_dt_interval(secs=(us / F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(18,6)"))
    return start + whole


def from_seconds(s: Column) -> Column:
    return from_micros(s.cast("bigint") * 1_000_000)
