"""Time-of-day expressions on hour and minute columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (first hour, last hour, English label, Japanese label).
PERIODS = [
    (0, 4, "Early Morning", "深夜"),
    (5, 8, "Morning", "早朝"),
    (9, 11, "Late Morning", "午前"),
    (12, 13, "Noon", "正午"),
    (14, 16, "Afternoon", "午後"),
    (17, 18, "Evening", "夕方"),
    (19, 21, "Night", "夜"),
    (22, 23, "Late Night", "深夜"),
]
SIMPLE_PERIODS = [
    (6, 11, "Morning", "朝"),
    (12, 17, "Afternoon", "昼"),
    (18, 23, "Evening", "夜"),
    (0, 5, "Night", "深夜"),
]
TIME_ZONES = [
    (6, 11, "Morning (6-11)", "朝（6-11時）"),
    (12, 17, "Afternoon (12-17)", "昼（12-17時）"),
    (18, 23, "Evening (18-23)", "夜（18-23時）"),
    (0, 5, "Night (0-5)", "深夜（0-5時）"),
]
BUSINESS_HOURS = (9, 17)
MORNING_RUSH = (7, 9)
EVENING_RUSH = (17, 19)
BREAKFAST = (7, 9)
LUNCH = (12, 13)
DINNER = (18, 20)

# Attendance above which a label applies.
ATTENDANCE_BANDS = [(40000, "Packed", "超満員"), (30000, "Full", "満員"), (20000, "Normal", "普通")]
ATTENDANCE_REST = ("Low", "少ない")


def band(hour: Column, bands, label: int) -> Column:
    """Label of the band the hour falls in; `label` 2 is English, 3 Japanese."""
    out = None
    for row in bands:
        test = hour.between(row[0], row[1])
        out = F.when(test, row[label]) if out is None else out.when(test, row[label])
    return out


def above(value: Column, bands, rest, label: int) -> Column:
    """First label whose limit is below `value`, else the rest label."""
    out = F.when(value > bands[0][0], bands[0][label])
    for row in bands[1:]:
        out = out.when(value > row[0], row[label])
    return out.otherwise(rest[label - 1])


def within(hour: Column, span: tuple[int, int]) -> Column:
    return hour.between(*span)


def hour12(hour: Column) -> Column:
    return ((hour + 11) % 12 + 1).cast("int")


def am_pm(hour: Column, am: str = "AM", pm: str = "PM") -> Column:
    return F.when(hour < 12, am).otherwise(pm)


def hhmm(hour: Column, minute: Column) -> Column:
    return F.format_string("%02d:%02d", hour, minute)


def shifted_hhmm(minute_of_day: Column, by: int) -> Column:
    """Clock text `by` minutes away, around midnight."""
    m = F.pmod(minute_of_day + by, F.lit(1440)).cast("int")
    return hhmm(F.floor(m / 60).cast("int"), (m % 60).cast("int"))


def group_of(minute: Column, width: int) -> Column:
    """Number (from 1) of the `width`-minute group in the hour."""
    return (F.floor(minute / width) + 1).cast("int")


def group_label(minute: Column, width: int) -> Column:
    """`MM-MM` label of the group inside the hour."""
    start = (F.floor(minute / width) * width).cast("int")
    return F.format_string("%02d-%02d", start, start + (width - 1))


def group_span(hour: Column, minute: Column, width: int) -> Column:
    """`HH:MM-HH:MM` label of the group; groups divide the hour, so it never spills over."""
    start = (F.floor(minute / width) * width).cast("int")
    return F.format_string("%02d:%02d-%02d:%02d", hour, start, hour, start + (width - 1))
