"""Game schedule fact and its calendar and clock analyses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions import clock, dates
from granary.functions.values import exact_avg, floor_round
from granary.operators import dims
from granary.operators.joins import null_safe_join
from granary.operators.ordered import global_row_number
from granary.plans.calendar import CALENDAR_SQL, ORDER_DAYS, TIME_SQL, order_calendar
from granary.plans.duck import fr, with_
from granary.plans.registry import query
from granary.sources import adapters as A

GAME = ["gameId", "gameNumber", "seasonId", "year", "homeTeamId", "homeTeamName", "awayTeamId", "awayTeamName", "startTime",
        "game_date", "game_hour", "game_minute", "dayNight", "game_type", "duration", "duration_minutes", "status", "created", "attendance"]
CAL = ["year_value", "month_value", "day_value", "quarter_value", "week_of_year", "day_of_week", "day_of_year", "month_name_en",
       "month_name_short_en", "month_name_jp", "day_name_en", "day_name_short_en", "day_name_jp", "day_name_short_jp", "is_weekend",
       "is_weekday", "is_first_day_of_month", "is_last_day_of_month", "is_first_day_of_quarter", "is_last_day_of_quarter",
       "fiscal_year_jp", "fiscal_quarter_jp", "iso_week_of_year", "iso_year"]
TIME = ["time_24h", "time_12h", "am_pm", "am_pm_jp", "time_period_en", "time_period_jp", "time_period_simple_en", "time_period_simple_jp",
        "is_business_hours", "is_morning_rush", "is_evening_rush", "is_rush_hour", "is_breakfast_time", "is_lunch_time", "is_dinner_time",
        "quarter_hour", "quarter_hour_label", "half_hour", "half_hour_label", "five_minute_group", "ten_minute_group"]


def base_games(spark: SparkSession, root: str) -> DataFrame:
    """Started games with their calendar and clock keys."""
    g = A.games(spark, root).where("startTime is not null")
    return g.selectExpr(
        "*", "type as game_type", "cast(date_format(startTime, 'yyyyMMdd') as int) as game_date_sk",
        "hour(startTime) * 100 + minute(startTime) as game_time_sk", "to_date(startTime) as game_date",
        "hour(startTime) as game_hour", "minute(startTime) as game_minute",
    ).drop("type")


def with_calendar(spark: SparkSession, root: str, games: DataFrame, how: str = "left") -> DataFrame:
    # One row per day; no hint, so Spark broadcasts it by its measured size.
    return games.join(order_calendar(spark, root), F.col("game_date_sk") == F.col("calendar_sk"), how)


def with_clock(spark: SparkSession, games: DataFrame) -> DataFrame:
    # 1,440 rows.
    return games.join(F.broadcast(dims.time_of_day(spark)), F.col("game_time_sk") == F.col("time_sk"), "left")


def fct_game_schedule(spark: SparkSession, root: str) -> DataFrame:
    """Fact with a surrogate key over (gameId, gameNumber), calendar and clock columns."""
    numbered = global_row_number(base_games(spark, root), [F.col("gameId"), F.col("gameNumber")], "game_schedule_sk")
    joined = with_clock(spark, with_calendar(spark, root, numbered))
    return joined.select("game_schedule_sk", "game_date_sk", "game_time_sk", *GAME, *CAL, *TIME)


_GQ = {"gameId", "gameNumber", "seasonId", "homeTeamId", "homeTeamName", "awayTeamId", "awayTeamName", "startTime", "dayNight"}


def _q(names: list[str], prefix: str) -> str:
    return ", ".join(f'{prefix}."{n}"' if n in _GQ else f"{prefix}.{n}" for n in names)


FACT_SQL = f""", {ORDER_DAYS}, cal as ({CALENDAR_SQL}), tim as ({TIME_SQL}),
fb as (select *, type as game_type, cast(strftime("startTime",'%Y%m%d') as integer) as game_date_sk, cast(hour("startTime")*100+minute("startTime") as integer) as game_time_sk,
  cast("startTime" as date) as game_date, cast(hour("startTime") as integer) as game_hour, cast(minute("startTime") as integer) as game_minute,
  row_number() over (order by "gameId", "gameNumber") as game_schedule_sk from games where "startTime" is not null),
fact as (select f.game_schedule_sk, f.game_date_sk, f.game_time_sk, {_q(GAME, 'f')}, {_q(CAL, 'c')}, {_q(TIME, 't')}, c.is_leap_year, c.date_value, t.hour_value, t.minute_value
  from fb f left join cal c on f.game_date_sk=c.calendar_sk left join tim t on f.game_time_sk=t.time_sk)"""

query("fct_game_schedule", with_("games", FACT_SQL + " select * exclude (is_leap_year, date_value, hour_value, minute_value) from fact"))(fct_game_schedule)


# --- schedule summary -----------------------------------------------------------------


def enriched(spark: SparkSession, root: str) -> DataFrame:
    """Games with calendar columns, time-zone and season labels; no surrogate key."""
    g = with_calendar(spark, root, base_games(spark, root), "inner")
    hour, month = F.col("game_hour"), F.col("month_value")
    return g.withColumns({
        "season_year": F.col("year"),
        "time_zone_jp": clock.band(hour, clock.TIME_ZONES, 3), "time_zone_en": clock.band(hour, clock.TIME_ZONES, 2),
        "season_jp": dates.pick(dates.SEASONS_JP, month), "season_en": dates.pick(dates.SEASONS_EN, month),
    })


ENRICHED = ["gameId", "gameNumber", "seasonId", "season_year", "homeTeamId", "homeTeamName", "awayTeamId", "awayTeamName", "startTime",
            "game_date", "game_hour", "dayNight", "game_type", "status", "attendance", "duration_minutes", "date_value", *CAL, "is_leap_year",
            "time_zone_jp", "time_zone_en", "season_jp", "season_en"]


def schedule_enriched(spark: SparkSession, root: str) -> DataFrame:
    return enriched(spark, root).select(*ENRICHED)


_TZ = """case when game_hour<6 then '{n}' when game_hour<12 then '{m}' when game_hour<18 then '{a}' else '{e}' end"""
_SEASON = """case when month_value in (3,4,5) then '{0}' when month_value in (6,7,8) then '{1}' when month_value in (9,10,11) then '{2}' else '{3}' end"""
ENR_SQL = FACT_SQL + f""", enr as (select *, year as season_year,
  {_TZ.format(n='深夜（0-5時）', m='朝（6-11時）', a='昼（12-17時）', e='夜（18-23時）')} as time_zone_jp,
  {_TZ.format(n='Night (0-5)', m='Morning (6-11)', a='Afternoon (12-17)', e='Evening (18-23)')} as time_zone_en,
  {_SEASON.format('春', '夏', '秋', '冬')} as season_jp, {_SEASON.format('Spring', 'Summer', 'Fall', 'Winter')} as season_en from fact where date_value is not null)"""
query("anl_schedule_enriched", with_("games", ENR_SQL + f" select {_q(ENRICHED, 'enr')} from enr"))(schedule_enriched)

# Whole-number sums make the averages exact: sum as double / count.
AVG_ATT = "cast(sum(attendance) as double) / count(attendance)"
AVG_DUR = "cast(sum(duration_minutes) as double) / count(duration_minutes)"


@dataclass(frozen=True)
class Distinct:
    """A count of the distinct values of a column, of all rows or of those that pass a test."""

    column: str
    test: str = "true"

    def sql(self) -> str:
        return f"count(distinct {self.column})" if self.test == "true" else f"count(distinct case when {self.test} then {self.column} end)"


Measures = dict[str, "str | Distinct"]


def _grouped(df: DataFrame, keys: list[str], measures: Measures) -> DataFrame:
    """Group with the given measures, distinct counts apart.

    Many conditional distinct counts in one aggregate would copy every row once per
    count. Here each counted column gets one pass instead: rows are combined per
    (group, value) with a flag per condition, and the flags are counted. The passes join
    on the group keys, one row per group.
    """
    plain = {name: m for name, m in measures.items() if isinstance(m, str)}
    counted: dict[str, dict[str, str]] = {}
    for name, m in measures.items():
        if isinstance(m, Distinct):
            counted.setdefault(m.column, {})[name] = m.test
    out = df.groupBy(*keys).agg(*[F.expr(text).alias(name) for name, text in plain.items()])
    for column, tests in counted.items():
        flags = [F.expr(f"coalesce(max({test}), false)").alias(name) for name, test in tests.items()]
        per_value = df.where(f"{column} is not null").groupBy(*keys, column).agg(*flags)
        counts = per_value.groupBy(*keys).agg(*[F.count_if(name).alias(name) for name in tests])
        out = null_safe_join(out, counts, keys, "left").fillna(0, subset=list(tests))
    return out.select(*keys, *measures)


def _duck(keys: list[str], measures: Measures, source: str, where: str = "") -> str:
    """The same measures for the check engine, which needs quotes around mixed-case names and narrower sums."""

    def fix(text: str) -> str:
        for name in sorted(_GQ):
            text = text.replace(name, f'"{name}"')
        return text

    parts = []
    for name, measure in measures.items():
        text = fix(measure.sql() if isinstance(measure, Distinct) else measure)
        parts.append(f"cast({text} as bigint) as {name}" if text.startswith("sum(") else f"{text} as {name}")
    return f"select {fix(', '.join(keys))}, {', '.join(parts)} from {source} {where} group by {fix(', '.join(keys))}"


def _register(key: str, build, sql_head: str, source: str, keys: list[str], measures: Measures, where: str = "") -> None:
    """One summary: the measure texts are plain SQL that both engines accept."""

    def run(spark: SparkSession, root: str) -> DataFrame:
        df = build(spark, root)
        return _grouped(df.where(where.replace("where ", "")) if where else df, keys, measures)

    query(key, with_("games", sql_head + " " + _duck(keys, measures, source, where)))(run)


GAMES = Distinct("gameId")


def games_if(test: str) -> Distinct:
    return Distinct("gameId", test)


_register("anl_monthly_summary", enriched, ENR_SQL, "enr", ["year_value", "month_value", "month_name_jp", "month_name_en"], {
    "total_games": GAMES, "weekend_games": games_if("is_weekend"), "weekday_games": games_if("is_weekday"),
    "total_attendance": "sum(attendance)", "avg_attendance": AVG_ATT, "avg_duration_minutes": AVG_DUR,
    "unique_home_teams": Distinct("homeTeamId"), "unique_away_teams": Distinct("awayTeamId"),
})
_register("anl_dow_summary", enriched, ENR_SQL, "enr", ["day_of_week", "day_name_jp", "day_name_en"], {
    "total_games": GAMES, "total_attendance": "sum(attendance)", "avg_attendance": AVG_ATT, "avg_duration_minutes": AVG_DUR})
_register("anl_timezone_summary", enriched, ENR_SQL, "enr", ["time_zone_jp", "time_zone_en", "dayNight"], {
    "total_games": GAMES, "total_attendance": "sum(attendance)", "avg_attendance": AVG_ATT})


# --- daily metrics and their roll-ups -------------------------------------------------

DAY_KEYS = ["calendar_sk", "date_value", "year_value", "month_value", "day_value", "quarter_value", "week_of_year", "day_of_week",
            "month_name_jp", "month_name_en", "day_name_jp", "day_name_en", "is_weekend", "is_weekday", "fiscal_year_jp", "fiscal_quarter_jp"]
DAY_MEASURES = {
    "games_count": GAMES, "total_attendance": "sum(attendance)", "avg_attendance": AVG_ATT, "max_attendance": "max(attendance)",
    "min_attendance": "min(attendance)", "avg_game_duration": AVG_DUR, "unique_home_teams": Distinct("homeTeamId"),
    "unique_away_teams": Distinct("awayTeamId"), "day_games": games_if("dayNight = 'D'"), "night_games": games_if("dayNight = 'N'"),
}


def daily_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Metrics of each day with games: the fact is grouped by its date key alone, then the
    calendar row is attached to one row per day."""
    per_day = _grouped(base_games(spark, root), ["game_date_sk"], DAY_MEASURES)
    return with_calendar(spark, root, per_day, "inner").select(*DAY_KEYS, *DAY_MEASURES)


DAILY_SQL = FACT_SQL + ", daily as (" + _duck(DAY_KEYS, DAY_MEASURES, "(select *, game_date_sk as calendar_sk from fact where date_value is not null) e") + ")"


def anl_daily_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Daily metrics with ranks and lags. Windows without a key run on one row per day."""
    by_day = W.orderBy("date_value")
    lag = F.lag
    return daily_metrics(spark, root).withColumns({
        "attendance_rank": F.rank().over(W.orderBy(F.desc("total_attendance"))),
        "games_count_rank": F.rank().over(W.orderBy(F.desc("games_count"))),
        "prev_day_games": lag("games_count", 1).over(by_day),
        "prev_day_attendance": lag("total_attendance", 1).over(by_day),
        "prev_year_same_day_games": lag("games_count", 365).over(by_day),
        "prev_year_same_day_attendance": lag("total_attendance", 365).over(by_day),
    }).orderBy("date_value")


query("anl_daily_metrics", with_("games", DAILY_SQL + """ select *, cast(rank() over (order by total_attendance desc) as integer) as attendance_rank,
  cast(rank() over (order by games_count desc) as integer) as games_count_rank, lag(games_count,1) over w as prev_day_games,
  lag(total_attendance,1) over w as prev_day_attendance, lag(games_count,365) over w as prev_year_same_day_games,
  lag(total_attendance,365) over w as prev_year_same_day_attendance from daily window w as (order by date_value)"""))(anl_daily_metrics)


def avg_of(expr: str, places: int = 4) -> str:
    """Average of averages: rounded, because its last bits depend on the order of the sum."""
    return f"floor((avg({expr}))*1e{places}+5e-1)/1e{places}"


_register("anl_monthly_aggregation", daily_metrics, DAILY_SQL, "daily",
          ["year_value", "month_value", "month_name_jp", "month_name_en", "fiscal_year_jp", "fiscal_quarter_jp"], {
              "days_with_games": Distinct("date_value", "games_count > 0"),
              "days_without_games": Distinct("date_value", "games_count = 0"),
              "monthly_total_games": "sum(games_count)", "monthly_total_attendance": "sum(total_attendance)",
              "monthly_avg_attendance": avg_of("avg_attendance"), "monthly_day_games": "sum(day_games)", "monthly_night_games": "sum(night_games)",
              "weekend_games": "sum(case when is_weekend then games_count else 0 end)",
              "weekday_games": "sum(case when is_weekday then games_count else 0 end)",
              "weekend_attendance": "sum(case when is_weekend then total_attendance else 0 end)",
              "weekday_attendance": "sum(case when is_weekday then total_attendance else 0 end)"})
_register("anl_yearly_aggregation", daily_metrics, DAILY_SQL, "daily", ["year_value", "fiscal_year_jp"], {
    "days_with_games": Distinct("date_value", "games_count > 0"),
    "yearly_total_games": "sum(games_count)", "yearly_total_attendance": "sum(total_attendance)", "yearly_avg_attendance": avg_of("avg_attendance"),
    "yearly_max_attendance": "max(max_attendance)",
    **{f"{name}_games": f"sum(case when month_value in {months} then games_count else 0 end)" for name, months in (
        ("spring", "(3,4,5)"), ("summer", "(6,7,8)"), ("fall", "(9,10,11)"), ("winter", "(12,1,2)"))}})
_register("anl_dow_pattern", daily_metrics, DAILY_SQL, "daily", ["day_of_week", "day_name_jp", "day_name_en"], {
    "total_games": "sum(games_count)", "avg_games_per_day": "cast(sum(games_count) as double) / count(*)", "total_attendance": "sum(total_attendance)",
    "avg_attendance": avg_of("avg_attendance"), "day_games": "sum(day_games)", "night_games": "sum(night_games)",
    "day_games_pct": "floor((cast(sum(day_games) as double) * 100 / nullif(sum(games_count), 0)) * 1e2 + 5e-1) / 1e2",
    "night_games_pct": "floor((cast(sum(night_games) as double) * 100 / nullif(sum(games_count), 0)) * 1e2 + 5e-1) / 1e2"}, "where games_count > 0")


# --- calendar roll-up by windows ------------------------------------------------------

ROLL_KEYS = ["date_value", "year_value", "month_value", "day_value", "quarter_value", "week_of_year", "iso_week_of_year", "fiscal_year_jp",
             "fiscal_quarter_jp", "year_month_int", "year_quarter_int", "day_of_week", "is_weekend", "is_weekday"]
ROLL_MEASURES = {
    "games_count": "count(gameId)", "total_attendance": "sum(attendance)", "avg_attendance": AVG_ATT, "max_attendance": "max(attendance)",
    "min_attendance": "min(attendance)", "total_duration_minutes": "sum(duration_minutes)", "avg_duration_minutes": AVG_DUR,
    "unique_home_teams": Distinct("homeTeamId"), "unique_away_teams": Distinct("awayTeamId"),
    "day_games": "sum(case when dayNight = 'D' then 1 else 0 end)", "night_games": "sum(case when dayNight = 'N' then 1 else 0 end)",
}
DAILY_NAMES = {
    "games_count": "daily_games", "total_attendance": "daily_attendance", "avg_attendance": "daily_avg_attendance",
    "max_attendance": "daily_max_attendance", "min_attendance": "daily_min_attendance", "total_duration_minutes": "daily_total_duration",
    "avg_duration_minutes": "daily_avg_duration", "unique_home_teams": "daily_unique_home_teams",
    "unique_away_teams": "daily_unique_away_teams", "day_games": "daily_day_games", "night_games": "daily_night_games",
}
# name -> (function of a column, column, partition, order and frame)
G, T_, AV, MX = "games_count", "total_attendance", "avg_attendance", "max_attendance"
YEAR, MONTH, QUARTER, WEEK = ["year_value"], ["year_value", "month_value"], ["year_value", "quarter_value"], ["year_value", "week_of_year"]
FY, FQ, DOW = ["fiscal_year_jp"], ["fiscal_year_jp", "fiscal_quarter_jp"], ["day_of_week"]
WK = ["year_value", "month_value", "is_weekend"]
TOTALS: list[tuple[str, str, str, list[str]]] = [
    ("weekly_games", "sum", G, WEEK), ("weekly_attendance", "sum", T_, WEEK), ("weekly_avg_attendance", "avg", AV, WEEK), ("weekly_max_attendance", "max", MX, WEEK),
    ("monthly_games", "sum", G, MONTH), ("monthly_attendance", "sum", T_, MONTH), ("monthly_avg_attendance", "avg", AV, MONTH), ("monthly_max_attendance", "max", MX, MONTH),
    ("monthly_days_with_games", "days", G, MONTH),
    ("quarterly_games", "sum", G, QUARTER), ("quarterly_attendance", "sum", T_, QUARTER), ("quarterly_avg_attendance", "avg", AV, QUARTER),
    ("yearly_games", "sum", G, YEAR), ("yearly_attendance", "sum", T_, YEAR), ("yearly_avg_attendance", "avg", AV, YEAR), ("yearly_max_attendance", "max", MX, YEAR),
    ("yearly_days_with_games", "days", G, YEAR),
    ("fiscal_year_games", "sum", G, FY), ("fiscal_year_attendance", "sum", T_, FY), ("fiscal_quarter_games", "sum", G, FQ), ("fiscal_quarter_attendance", "sum", T_, FQ),
    ("avg_games_by_day_of_week", "avg", G, DOW), ("avg_attendance_by_day_of_week", "avg", T_, DOW),
    ("monthly_weekend_weekday_games", "sum", G, WK), ("monthly_weekend_weekday_attendance", "sum", T_, WK),
]
RUNNING = [("ytd_games", G, YEAR), ("ytd_attendance", T_, YEAR), ("mtd_games", G, MONTH), ("mtd_attendance", T_, MONTH)]
MOVING = [("ma7_games", G, 6), ("ma7_attendance", T_, 6), ("ma30_games", G, 29), ("ma30_attendance", T_, 29)]
LAGS = [("prev_year_same_day_games", G, 365), ("prev_year_same_day_attendance", T_, 365), ("prev_month_same_day_games", G, 30), ("prev_month_same_day_attendance", T_, 30)]
RANKS = [("yearly_attendance_rank", "rank", T_, YEAR), ("monthly_attendance_rank", "rank", T_, MONTH), ("quarterly_games_rank", "dense_rank", G, QUARTER)]


def daily_base(spark: SparkSession, root: str) -> DataFrame:
    """Every calendar day with its metrics; days without games stay, with zero games.

    The fact is reduced to one row per day before it meets the calendar.
    """
    per_day = _grouped(base_games(spark, root), ["game_date_sk"], ROLL_MEASURES)
    joined = order_calendar(spark, root).join(per_day, F.col("calendar_sk") == F.col("game_date_sk"), "left")
    zero = ["games_count", "unique_home_teams", "unique_away_teams", "day_games", "night_games"]
    return joined.select(*ROLL_KEYS, *[F.coalesce(m, F.lit(0)).alias(m) if m in zero else F.col(m) for m in ROLL_MEASURES])


def _total(kind: str, column: str) -> Column:
    if kind == "days":
        return F.count(F.when(F.col(column) > 0, 1))
    if kind == "avg":
        return F.avg(column)
    return F.sum(column) if kind == "sum" else F.max(column)


def anl_calendar_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Day rows with totals of every calendar level around them.

    All windows run on one row per day (thousands of rows), so those without a key are
    safe. Windows are added grouped by partition so that neighbours share a sort.
    """
    days = daily_base(spark, root)
    out = days
    for part in (WEEK, WK, MONTH, QUARTER, YEAR, FQ, FY, DOW):
        w = W.partitionBy(*part)
        ordered = w.orderBy("date_value").rowsBetween(W.unboundedPreceding, 0)
        add = {n: floor_round(_total(k, c).over(w), 4) if k == "avg" else _total(k, c).over(w) for n, k, c, p in TOTALS if p == part}
        add |= {n: F.sum(c).over(ordered) for n, c, p in RUNNING if p == part}
        add |= {n: (F.rank() if k == "rank" else F.dense_rank()).over(w.orderBy(F.desc(c))) for n, k, c, p in RANKS if p == part}
        out = out.withColumns(add)
    by_day = W.orderBy("date_value")
    out = out.withColumns(
        {n: floor_round(F.avg(c).over(by_day.rowsBetween(-b, 0)), 4) for n, c, b in MOVING} | {n: F.lag(c, k).over(by_day) for n, c, k in LAGS}
    )
    return out.withColumnsRenamed(DAILY_NAMES).orderBy("date_value")


def _roll_sql() -> str:
    keys = ", ".join(f"c.{k}" for k in ROLL_KEYS)
    big = lambda t: f"cast({t} as bigint)"
    cols = []
    for n, k, c, p in TOTALS:
        over = f"over (partition by {', '.join(p)})"
        cols.append({"sum": big(f"sum({c}) {over}"), "max": f"max({c}) {over}", "days": f"count(case when {c}>0 then 1 end) {over}",
                     "avg": fr(f"avg({c}) {over}", 4)}[k] + f" as {n}")
    cols += [big(f"sum({c}) over (partition by {', '.join(p)} order by date_value rows between unbounded preceding and current row)") + f" as {n}" for n, c, p in RUNNING]
    cols += [fr(f"avg({c}) over (order by date_value rows between {b} preceding and current row)", 4) + f" as {n}" for n, c, b in MOVING]
    cols += [f"lag({c},{k}) over (order by date_value) as {n}" for n, c, k in LAGS]
    cols += [f"cast({k}() over (partition by {', '.join(p)} order by {c} desc nulls last) as integer) as {n}" for n, k, c, p in RANKS]
    daily = ", ".join(f"{a} as {b}" for a, b in DAILY_NAMES.items())
    base = _duck(["game_date_sk"], ROLL_MEASURES, "fb")
    zero = {"games_count", "unique_home_teams", "unique_away_teams", "day_games", "night_games"}
    meas = ", ".join(f"coalesce(g.{m},0) as {m}" if m in zero else f"g.{m}" for m in ROLL_MEASURES)
    return FACT_SQL + f""", perday as ({base}), base as (select {keys}, {meas} from cal c left join perday g on c.calendar_sk=g.game_date_sk)
select {', '.join(ROLL_KEYS)}, {daily}, {', '.join(cols)} from base"""


query("anl_calendar_rollup", with_("games", _roll_sql()))(anl_calendar_rollup)


# --- calendar hierarchy ---------------------------------------------------------------

LEVELS = {
    "ALL": [], "YEAR": ["year_value"], "YEAR_QUARTER": ["year_value", "quarter_value"], "YEAR_MONTH": ["year_value", "month_value"],
    "YEAR_WEEK": ["year_value", "week_of_year"], "YEAR_MONTH_DAY": ["year_value", "month_value", "day_value", "date_value"],
}
LEVEL_KEYS = ["year_value", "quarter_value", "month_value", "week_of_year", "day_value", "date_value"]


def hierarchy(spark: SparkSession, root: str) -> DataFrame:
    """Six calendar levels in one result.

    The fact is reduced once to (day: count, sum, sum of squares, min, max) and to
    distinct (day, team) pairs; GROUPING SETS then run over these, so the six-fold
    expansion applies to day rows, not to games. The deviation comes from exact whole
    numbers: (n*sum(x^2) - sum(x)^2) / (n*(n-1)).
    """
    cal = order_calendar(spark, root).select("calendar_sk", *LEVEL_KEYS)
    sets = ", ".join("(" + ", ".join(c) + ")" for c in LEVELS.values())
    keys = ", ".join(LEVEL_KEYS)
    gid = f"grouping_id({keys})"
    fact = base_games(spark, root)
    per_day = fact.groupBy("game_date_sk").agg(
        F.count("gameId").alias("n"), F.count("attendance").alias("n_att"), F.sum("attendance").alias("s"),
        F.sum(F.expr("cast(attendance as decimal(19,0)) * cast(attendance as decimal(19,0))")).alias("s2"),
        F.max("attendance").alias("mx"), F.min("attendance").alias("mn"),
    )
    # One row per day and team with the side it played on.
    teams = fact.select("game_date_sk", F.explode(F.array(
        F.struct(F.lit("H").alias("side"), F.col("homeTeamId").alias("team")), F.struct(F.lit("A").alias("side"), F.col("awayTeamId").alias("team"))
    )).alias("t")).select("game_date_sk", "t.side", "t.team").distinct()
    days = cal.join(per_day, F.col("calendar_sk") == F.col("game_date_sk"), "left")
    pairs = cal.join(teams, F.col("calendar_sk") == F.col("game_date_sk"), "left")
    sums = _grouping_sets(days, keys, sets, f"""{gid} as gid, coalesce(sum(n), 0) as total_games, sum(n_att) as n_att, sum(s) as total_attendance,
        cast(sum(s2) as decimal(38,0)) as s2, max(mx) as max_attendance, min(mn) as min_attendance, count(distinct date_value) as days_with_data""")
    heads = _grouping_sets(pairs, keys, sets, f"""{gid} as gid, count(distinct case when side = 'H' then team end) as unique_home_teams,
        count(distinct case when side = 'A' then team end) as unique_away_teams""")
    test = F.col("a.gid") == F.col("b.gid")
    for k in LEVEL_KEYS:
        test = test & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = sums.alias("a").join(heads.alias("b"), test).select("a.*", "b.unique_home_teams", "b.unique_away_teams")
    level = F.when(F.col("gid") == _gid([]), "ALL")
    for name, cols in list(LEVELS.items())[1:]:
        level = level.when(F.col("gid") == _gid(cols), name)
    order = F.when(F.col("gid") == _gid([]), 0)
    for i, cols in enumerate(list(LEVELS.values())[1:], 1):
        order = order.when(F.col("gid") == _gid(cols), i)
    n = F.col("n_att")
    spread = F.expr("cast(cast(n_att as decimal(19,0)) * cast(s2 as decimal(31,0)) as decimal(38,0)) - cast(total_attendance as decimal(19,0)) * cast(total_attendance as decimal(19,0))")
    avg = exact_avg(F.col("total_attendance"), n)
    out = joined.withColumns({
        "aggregation_level": level, "ord": order, "avg_attendance": avg,
        "stddev_attendance": F.when(n > 1, F.round(F.sqrt(spread.cast("double") / (n.cast("double") * (n - 1).cast("double"))), 4)),
        "avg_attendance_per_game": F.when(F.col("total_games") > 0, F.floor(F.col("total_attendance") / F.nullif("total_games", F.lit(0)) + 0.5).cast("double")).otherwise(0.0),
        "avg_games_per_day": F.when(F.col("days_with_data") > 0, floor_round(F.col("total_games") / F.nullif("days_with_data", F.lit(0)), 2)).otherwise(0.0),
        "performance_category_jp": F.when(avg > 35000, "高").when(avg > 25000, "中").otherwise("低"),
        "performance_category_en": F.when(avg > 35000, "High").when(avg > 25000, "Medium").otherwise("Low"),
    })
    return out.orderBy("ord", "year_value", "quarter_value", "month_value", "week_of_year", "date_value").select(
        "aggregation_level", *LEVEL_KEYS, "total_games", "total_attendance", "avg_attendance", "max_attendance", "min_attendance", "stddev_attendance",
        "unique_home_teams", "unique_away_teams", "days_with_data", "avg_attendance_per_game", "avg_games_per_day", "performance_category_jp", "performance_category_en")


def _grouping_sets(df: DataFrame, keys: str, sets: str, select: str) -> DataFrame:
    return df.sparkSession.sql(f"select {keys}, {select} from {{df}} group by grouping sets ({sets})", df=df)


def _gid(columns: list[str]) -> int:
    """grouping_id of a level: bit 1 for each key that is absent, first key highest."""
    return sum(1 << (len(LEVEL_KEYS) - 1 - i) for i, k in enumerate(LEVEL_KEYS) if k not in columns)


def _hier_sql(key_filter: str = "") -> str:
    selects = []
    for name, cols in LEVELS.items():
        keys = ", ".join(f"c.{k}" if k in cols else f"cast(null as {'date' if k == 'date_value' else 'integer'}) as {k}" for k in LEVEL_KEYS)
        group = f" group by {', '.join(f'c.{k}' for k in cols)}" if cols else ""
        selects.append(f"""select '{name}' as aggregation_level, {keys}, count(f."gameId") as total_games, cast(sum(f.attendance) as bigint) as total_attendance,
  cast(sum(f.attendance) as double)/nullif(count(f.attendance),0) as avg_attendance, max(f.attendance) as max_attendance, min(f.attendance) as min_attendance,
  round(stddev_samp(f.attendance),4) as stddev_attendance, count(distinct f."homeTeamId") as unique_home_teams, count(distinct f."awayTeamId") as unique_away_teams,
  count(distinct c.date_value) as days_with_data from cal c left join fb f on c.calendar_sk=f.game_date_sk{group}""")
    return FACT_SQL + f""", lv as ({' union all '.join(selects)})
select *, case when total_games>0 then floor(total_attendance/total_games+0.5) else 0.0 end as avg_attendance_per_game,
  case when days_with_data>0 then floor((total_games/days_with_data)*100.0+0.5)/100.0 else 0.0 end as avg_games_per_day,
  case when avg_attendance>35000 then '高' when avg_attendance>25000 then '中' else '低' end as performance_category_jp,
  case when avg_attendance>35000 then 'High' when avg_attendance>25000 then 'Medium' else 'Low' end as performance_category_en from lv"""


query("anl_hierarchy_agg", with_("games", _hier_sql()))(hierarchy)


# --- time patterns --------------------------------------------------------------------


def clocked(spark: SparkSession, root: str) -> DataFrame:
    """Games with all calendar and clock columns; no surrogate key."""
    return with_clock(spark, with_calendar(spark, root, base_games(spark, root)))


PATTERN = ["gameId", "startTime", "game_date", "year_value", "month_value", "month_name_jp", "month_name_en", "day_value", "day_name_jp",
           "day_name_en", "day_of_week", "week_of_year", "quarter_value", "is_weekend", "is_weekday", "fiscal_year_jp", "fiscal_quarter_jp",
           "hour_value", "minute_value", "time_24h", "time_12h", "am_pm_jp", "am_pm", "time_period_jp", "time_period_en",
           "time_period_simple_jp", "time_period_simple_en", "is_business_hours", "is_morning_rush", "is_evening_rush", "is_rush_hour",
           "is_breakfast_time", "is_lunch_time", "is_dinner_time", "quarter_hour", "quarter_hour_label", "half_hour", "half_hour_label",
           "five_minute_group", "ten_minute_group", "homeTeamName", "awayTeamName", "attendance", "duration_minutes", "dayNight", "status"]


def anl_time_patterns(spark: SparkSession, root: str) -> DataFrame:
    att = F.col("attendance")
    df = clocked(spark, root).withColumns({
        "attendance_category_jp": clock.above(att, clock.ATTENDANCE_BANDS, clock.ATTENDANCE_REST, 2),
        "attendance_category_en": clock.above(att, clock.ATTENDANCE_BANDS, clock.ATTENDANCE_REST, 1),
    })
    return df.select(*PATTERN, "attendance_category_jp", "attendance_category_en").orderBy("startTime", "gameId")


query("anl_time_patterns", with_("games", FACT_SQL + f""" select {_q(PATTERN, 'fact')},
  case when attendance>40000 then '超満員' when attendance>30000 then '満員' when attendance>20000 then '普通' else '少ない' end as attendance_category_jp,
  case when attendance>40000 then 'Packed' when attendance>30000 then 'Full' when attendance>20000 then 'Normal' else 'Low' end as attendance_category_en from fact"""))(anl_time_patterns)

_SEASONS = {"spring": "(3,4,5)", "summer": "(6,7,8)", "fall": "(9,10,11)", "winter": "(12,1,2)"}
_DAYS = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def att_if(test: str) -> str:
    return f"cast(sum(case when {test} then attendance end) as double) / count(case when {test} then attendance end)"


_register("anl_time_period", clocked, FACT_SQL, "fact", ["time_period_jp", "time_period_en"], {
    "total_games": GAMES, "total_attendance": "sum(attendance)", "avg_attendance": AVG_ATT, "avg_duration": AVG_DUR,
    **{f"{d}_games": games_if(f"day_of_week = {i + 1}") for i, d in enumerate(_DAYS)},
    "weekend_games": games_if("is_weekend"), "weekday_games": games_if("is_weekday"),
    **{f"{s}_games": games_if(f"month_value in {m}") for s, m in _SEASONS.items()}})


def _null_safe(text: str) -> str:
    """Averages over a possibly empty choice: null instead of a division by zero."""
    top, bottom = text.split(" / ")
    return f"{top} / nullif({bottom}, 0)"


_register("anl_hourly", clocked, FACT_SQL, "fact", ["hour_value", "am_pm_jp", "am_pm"], {
    "hour_label": "max(concat(substr(time_24h, 1, 3), '00'))", "total_games": GAMES, "total_attendance": "sum(attendance)", "avg_attendance": AVG_ATT,
    "stddev_attendance": "round(stddev_samp(attendance), 4)", "min_attendance": "min(attendance)", "max_attendance": "max(attendance)",
    **{f"{m}_avg_attendance": _null_safe(att_if(f"month_value = {i + 1}")) for i, m in enumerate(_MONTHS)}})
_register("anl_quarter_hour", clocked, FACT_SQL, "fact",
          ["hour_value", "quarter_hour", "quarter_hour_label", "time_period_simple_jp", "time_period_simple_en"], {
              "total_games": GAMES, "total_attendance": "sum(attendance)", "avg_attendance": AVG_ATT,
              "weekend_avg_attendance": _null_safe(att_if("is_weekend")), "weekday_avg_attendance": _null_safe(att_if("is_weekday")),
              "weekend_games": games_if("is_weekend"), "weekday_games": games_if("is_weekday")})

_MEAL = "case when is_breakfast_time then '{0}' when is_lunch_time then '{1}' when is_dinner_time then '{2}' else '{3}' end as {4}"
_RUSH = "case when is_morning_rush then '{0}' when is_evening_rush then '{1}' when is_rush_hour then '{2}' else '{3}' end as {4}"
_MEALS = [_MEAL.format("朝食時間帯", "昼食時間帯", "夕食時間帯", "その他", "meal_time_jp"),
          _MEAL.format("Breakfast Time", "Lunch Time", "Dinner Time", "Other", "meal_time_en")]
_RUSHES = [_RUSH.format("朝のラッシュ", "夕方のラッシュ", "ラッシュアワー", "通常時間", "rush_hour_type_jp"),
           _RUSH.format("Morning Rush", "Evening Rush", "Rush Hour", "Normal Hours", "rush_hour_type_en")]
# One row per meal and year: the columns don't follow the data.
_register("anl_meal_time", lambda spark, root: clocked(spark, root).selectExpr("*", *_MEALS), FACT_SQL, f"(select *, {', '.join(_MEALS)} from fact) m",
          ["meal_time_jp", "meal_time_en", "year_value"], {"total_games": GAMES, "total_attendance": "sum(attendance)", "avg_attendance": AVG_ATT},
          "where is_breakfast_time or is_lunch_time or is_dinner_time")
_register("anl_rush_hour", lambda spark, root: clocked(spark, root).selectExpr("*", *_RUSHES), FACT_SQL, f"(select *, {', '.join(_RUSHES)} from fact) r",
          ["rush_hour_type_jp", "rush_hour_type_en"], {
              "total_games": GAMES, "total_attendance": "sum(attendance)", "avg_attendance": AVG_ATT, "avg_duration": AVG_DUR})
