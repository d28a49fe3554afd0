"""Slowly changing dimensions and snapshots over web visits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.hashing import surrogate_key
from granary.operators import scd
from granary.operators.joins import asof_join
from granary.operators.ordered import latest_per_key
from granary.plans.duck import sha_b64, surrogate, with_
from granary.plans.registry import open_ended, query
from granary.sources import adapters as A
from granary.sources.tables import cut_lineage

ATTRS = ["continent", "sub_continent", "country", "browser", "os", "device_category", "is_mobile"]
CUT = "2024-01-16"


def visits(spark: SparkSession, root: str, first_visits: bool = True) -> DataFrame:
    """Flattened visits: visitor, attributes, time of access and totals."""
    return A.ga_sessions(spark, root, first_visits).selectExpr(
        "fullVisitorId as visitor_id", "visitId as visit_id", "dt", "to_date(dt, 'yyyyMMdd') as transaction_date",
        f"{A.EPOCH} + make_dt_interval(0, 0, 0, cast(visitStartTime as decimal(18,6))) as access_timestamp",
        "geoNetwork.continent", "geoNetwork.subContinent as sub_continent", "geoNetwork.country", "device.browser",
        "device.operatingSystem as os", "device.deviceCategory as device_category", "device.isMobile as is_mobile",
        "totals.newVisits is not null as is_new_visits", "totals.visits", "totals.hits", "totals.pageviews",
        "totals.timeOnSite as time_on_site",
    )


def _at(day: str):
    return F.lit(day).cast("timestamp_ntz")


def dim_users(spark: SparkSession, root: str, sk: str = "md5") -> DataFrame:
    return scd.scd2(visits(spark, root, False), "visitor_id", ATTRS, "access_timestamp", sk=sk)


def dim_users_two_runs(spark: SparkSession, root: str, sk: str = "md5") -> DataFrame:
    """The dimension loaded in two runs, before and after a day."""
    v = visits(spark, root, False)
    first = scd.scd2(v.where(F.col("access_timestamp") < _at(CUT)), "visitor_id", ATTRS, "access_timestamp", sk=sk)
    rows = scd.scd2(v.where(F.col("access_timestamp") >= _at(CUT)), "visitor_id", ATTRS, "access_timestamp", state=first, sk=sk)
    return scd.scd2_merge(first, rows)


_A = ", ".join(ATTRS)
_HASH = sha_b64(*ATTRS)
DIM_USERS = f""", h as (select visitor_id, {_A}, {_HASH} as hash_value, access_timestamp as valid_from from visits),
u as (select * from (select *, row_number() over (partition by visitor_id, valid_from order by hash_value) rn from h) q where rn=1),
c as (select *, lag(hash_value) over (partition by visitor_id order by valid_from) as prev from u),
d0 as (select visitor_id, {_A}, hash_value, valid_from, lead(valid_from) over (partition by visitor_id order by valid_from) as nx
  from c where prev is null or prev<>hash_value),
d as (select visitor_id, {_A}, hash_value, valid_from, coalesce(nx - interval 1 second, timestamp '9999-12-31') as valid_to, nx is null as is_current from d0)"""
_SK = surrogate("visitor_id", "strftime(valid_from,'%Y-%m-%d %H:%M:%S')")
_RANK = f"""select dense_rank() over (order by grp, valid_from, visitor_id) as user_sk, visitor_id, {_A}, hash_value, valid_from, valid_to, is_current
  from (select *, {{grp}} as grp from d) q"""

open_ended("scd2_hash_key", with_("visits", DIM_USERS + f" select {_SK} as user_sk, * from d"))(lambda spark, root: dim_users(spark, root))
open_ended("scd2_hash_key_incremental", with_("visits", DIM_USERS + f" select {_SK} as user_sk, * from d"))(
    lambda spark, root: dim_users_two_runs(spark, root))
open_ended("scd2_int_key", with_("visits", DIM_USERS + _RANK.format(grp="0")))(lambda spark, root: dim_users(spark, root, "int"))
open_ended("scd2_int_key_incremental", with_("visits", DIM_USERS + _RANK.format(grp=f"case when valid_from < timestamp '{CUT}' then 0 else 1 end")))(
    lambda spark, root: dim_users_two_runs(spark, root, "int"))


def backfilled(spark: SparkSession, root: str) -> DataFrame:
    """The dimension loaded week by week, each run on the state of the one before."""
    v = visits(spark, root, False)
    ts, first, second = F.col("access_timestamp"), _at("2024-01-11"), _at("2024-01-21")
    parts = [v.where(ts < first), v.where((ts >= first) & (ts < second)), v.where(ts >= second)]

    def step(state: DataFrame | None, batch: DataFrame) -> DataFrame:
        return scd.scd2_merge(state, scd.scd2(batch, "visitor_id", ATTRS, "access_timestamp", state=state))

    return scd.backfill(step, parts)


open_ended("backfill_by_date", with_("visits", DIM_USERS + f" select {_SK} as user_sk, * from d"))(backfilled)



def late_rows(spark: SparkSession, root: str) -> DataFrame:
    """The dimension loaded in three batches that are dealt by visit, not by time: most rows of the later ones are late."""
    v = visits(spark, root, False)
    deal = F.pmod(F.col("visit_id").cast("bigint"), F.lit(3))
    state = None
    for i in range(3):
        batch, source = v.where(deal == i), v.where(deal <= i)
        state = cut_lineage(scd.scd2_recut(state, batch, "visitor_id", ATTRS, "access_timestamp", source))
    return state


open_ended("scd2_late_row", with_("visits", DIM_USERS + f" select {_SK} as user_sk, * from d"))(late_rows)

# --- customers by first-seen attribute set -------------------------------------------

CATTRS = ["first_name", "last_name"]


def payments_stage(spark: SparkSession, root: str, first_run: bool = False) -> DataFrame:
    """Orders with customer and payments; two dated overrides of the last name."""
    c = A.table(spark, root, "customer").selectExpr("c_custkey", "concat('First', c_custkey % 50) as first_name", "concat(substr('PQRS', cast(c_custkey % 4 + 1 as int), 1), '.') as ln")
    o = A.table(spark, root, "orders").selectExpr("o_orderkey", "o_custkey", "to_date(o_orderdate) as order_date", "o_orderstatus as status")
    joined = o.join(c, F.expr("o_custkey = c_custkey")).join(A.payments(spark, root), F.expr("o_orderkey = order_id"))
    unknown = "when ln = 'P.' and order_date < date'1996-01-01' then null" if first_run else ""
    return joined.selectExpr(
        "order_date", "o_custkey as user_id", "first_name",
        f"case when ln = 'P.' and order_date >= date'1999-01-01' then 'W.' {unknown} else ln end as last_name",
        "order_id", "status", "payment_method", "amount",
    )


def _stage_sql(first_run: bool = False) -> str:
    unknown = "when ln='P.' and order_date < date '1996-01-01' then null" if first_run else ""
    return f"""pay as (select order_date, user_id, first_name, case when ln='P.' and order_date >= date '1999-01-01' then 'W.' {unknown} else ln end as last_name,
   order_id, status, payment_method, amount from (
   select cast(o_orderdate as date) as order_date, o_custkey as user_id, 'First'||(c_custkey%50) as first_name,
     substr('PQRS', cast(c_custkey%4+1 as integer), 1)||'.' as ln, order_id, o_orderstatus as status, payment_method, amount
   from orders join customer on o_custkey=c_custkey join payments on order_id=o_orderkey) x)"""


query("stg_payment_join", with_("payments", f", {_stage_sql()} select * from pay"))(lambda spark, root: payments_stage(spark, root))


def dim_customers(spark: SparkSession, root: str) -> DataFrame:
    """Two runs: orders up to 1998, then later ones."""
    p = payments_stage(spark, root, first_run=True)
    edge = F.to_date(F.lit("1998-01-01"))
    first = scd.scd2_first_seen(p.where(F.col("order_date") < edge), "user_id", CATTRS, "order_date")
    rows = scd.scd2_first_seen(p.where(F.col("order_date") >= edge), "user_id", CATTRS, "order_date", state=first)
    return scd.scd2_merge(first, rows, "customer_sk")


_CH = sha_b64(*CATTRS)
_CUST = f""", {_stage_sql(True)},
n1 as (select user_id, first_name, last_name, {_CH} as hash_value, cast(min(order_date) as timestamp) as valid_from from pay where order_date < date '1998-01-01' group by 1,2,3,4),
s1 as (select dense_rank() over (order by valid_from, user_id, hash_value) as customer_sk, *, lead(valid_from) over (partition by user_id order by valid_from, hash_value) as nx from n1),
n2 as (select user_id, first_name, last_name, {_CH} as hash_value, cast(min(order_date) as timestamp) as valid_from from pay where order_date >= date '1998-01-01' group by 1,2,3,4),
a2 as (select n2.* from n2 where not exists (select 1 from s1 where s1.nx is null and s1.user_id=n2.user_id and s1.hash_value=n2.hash_value)),
s2 as (select dense_rank() over (order by valid_from, user_id, hash_value) + (select max(customer_sk) from s1) as customer_sk, * from a2),
allv as (select customer_sk, user_id, first_name, last_name, hash_value, valid_from from s1 union all select * from s2),
dimc as (select *, lead(valid_from) over (partition by user_id order by valid_from, hash_value) as nx from allv)"""
open_ended("scd2_customers", with_("payments", _CUST + """ select customer_sk, user_id, first_name, last_name, hash_value, valid_from,
  coalesce(nx - interval 1 second, timestamp '9999-12-31') as valid_to, nx is null as is_current from dimc"""))(dim_customers)


def corrected(spark: SparkSession, root: str) -> DataFrame:
    """History from a faulty first run, then replayed from 1998 with the corrected source."""
    p = payments_stage(spark, root, first_run=True)
    faulty = p.withColumn("last_name", F.expr("case when order_date >= date'1998-06-01' and user_id % 3 = 0 then concat(last_name, '?') else last_name end"))
    # The faulty run also missed one month of orders.
    faulty = faulty.where(~F.col("order_date").between(F.to_date(F.lit("1999-01-01")), F.to_date(F.lit("1999-01-31"))))
    state = scd.scd2_first_seen(faulty, "user_id", CATTRS, "order_date")
    since = "1998-01-01"
    replay = p.where(F.col("order_date") >= F.to_date(F.lit(since)))
    rows = scd.scd2_correct(state, replay, "user_id", CATTRS, "order_date", since)
    return scd.scd2_merge(state, rows, "customer_sk")


_FIX = f""", {_stage_sql(True)},
bad as (select order_date, user_id, first_name, case when order_date >= date '1998-06-01' and user_id%3=0 then last_name||'?' else last_name end as last_name
  from pay where not (order_date between date '1999-01-01' and date '1999-01-31')),
n1 as (select user_id, first_name, last_name, {_CH} as hash_value, cast(min(order_date) as timestamp) as valid_from from bad group by 1,2,3,4),
s1 as (select dense_rank() over (order by valid_from, user_id, hash_value) as customer_sk, * from n1),
n2 as (select user_id, first_name, last_name, {_CH} as hash_value, cast(min(order_date) as timestamp) as valid_from from pay where order_date >= date '1998-01-01' group by 1,2,3,4),
fixed as (select s1.customer_sk, n2.* from s1 join n2 on s1.user_id=n2.user_id and s1.valid_from=n2.valid_from where s1.valid_from >= timestamp '1998-01-01' and s1.hash_value<>n2.hash_value),
miss as (select n2.* from n2 where not exists (select 1 from s1 where s1.user_id=n2.user_id and s1.valid_from=n2.valid_from)),
ins as (select dense_rank() over (order by valid_from, user_id, hash_value) + (select max(customer_sk) from s1) as customer_sk, * from miss),
allv as (select customer_sk, user_id, first_name, last_name, hash_value, valid_from from s1 where customer_sk not in (select customer_sk from fixed)
  union all select * from fixed union all select * from ins),
dimc as (select *, lead(valid_from) over (partition by user_id order by valid_from, hash_value) as nx from allv)"""
open_ended("scd2_late_correction", with_("payments", _FIX + """ select customer_sk, user_id, first_name, last_name, hash_value, valid_from,
  coalesce(nx - interval 1 second, timestamp '9999-12-31') as valid_to, nx is null as is_current from dimc"""))(corrected)

# --- facts ----------------------------------------------------------------------------

FACT = ["visit_id", "transaction_date", "access_timestamp", "is_new_visits", "visits", "hits", "pageviews", "time_on_site"]


def fct_visits(spark: SparkSession, root: str, sk: str = "md5", closed: bool = True) -> DataFrame:
    """Visits with the key of the user version valid at the time of the visit."""
    v = visits(spark, root).select("visitor_id", *FACT)
    d = dim_users(spark, root, sk)
    joined = asof_join(v, d, "visitor_id", "visitor_id", "access_timestamp", "valid_from", "valid_to", ["user_sk"], closed=closed)
    return joined.select("user_sk", *FACT)


_F = ", ".join(f"v.{c}" for c in FACT)
_VALID = "v.visitor_id=r.visitor_id and v.access_timestamp between r.valid_from and r.valid_to"
query("fct_visits", with_("visits", DIM_USERS + f""", r as (select {_SK} as user_sk, * from d)
select r.user_sk, {_F} from visits v left join r on {_VALID}"""))(lambda spark, root: fct_visits(spark, root))
query("fct_visits_sk_int", with_("visits", DIM_USERS + f""", r as (select dense_rank() over (order by valid_from, visitor_id) as user_sk, * from d)
select r.user_sk, {_F} from visits v left join r on {_VALID}"""))(
    lambda spark, root: fct_visits(spark, root, "int"))

# --- snapshots ------------------------------------------------------------------------

SNAP_DAYS = ("2024-01-10", "2024-01-20", "2024-01-31")


def _latest_visits(spark: SparkSession, root: str, upto: str) -> DataFrame:
    """One row per visitor: the last visit before a day."""
    v = visits(spark, root, False).where(F.col("access_timestamp") < _at(upto))
    v = latest_per_key(v.select("visitor_id", *ATTRS, "access_timestamp", "visit_id"), "visitor_id", [F.col("access_timestamp"), F.col("visit_id")])
    return v.withColumn("hash_value", surrogate_key(v, ATTRS)).drop("visit_id", "access_timestamp")


def _snap_days(spark: SparkSession, root: str) -> list[str]:
    """The set runs, and one at the midnight after the last visit if that is later: no visit is left out."""
    end = visits(spark, root, False).agg(F.date_format(F.date_add(F.to_date(F.max("access_timestamp")), 1), "yyyy-MM-dd")).first()[0]
    return [*SNAP_DAYS, *([end] if end and end > SNAP_DAYS[-1] else [])]


def snap_check(spark: SparkSession, root: str) -> DataFrame:
    state = None
    for day in _snap_days(spark, root):
        # Each run is a job of its own that leaves a stored table.
        state = cut_lineage(scd.snapshot(_latest_visits(spark, root, day), "visitor_id", ["hash_value"], f"{day} 00:00:00", state=state))
    return state


_SN = surrogate(*ATTRS)
_SNAPS = ", ".join(f"""b{i} as (select visitor_id, {_A}, {_SN} as hash_value from (
  select *, row_number() over (partition by visitor_id order by access_timestamp desc, visit_id desc) rn from visits where access_timestamp < timestamp '{d}') q where rn=1)""" for i, d in enumerate(SNAP_DAYS))
query("snap_check", with_("visits", f""", {_SNAPS},
runs as ({' union all '.join(f"select *, timestamp '{d}' as run from b{i}" for i, d in enumerate(SNAP_DAYS))}),
chg as (select * from (select *, lag(hash_value) over (partition by visitor_id order by run) as prev from runs) q where prev is null or prev<>hash_value)
select visitor_id, {_A}, hash_value, run as valid_from, lead(run) over (partition by visitor_id order by run) as valid_to from chg"""))(snap_check)
