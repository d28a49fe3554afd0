"""Stand-in source tables, derived by Spark from the given tables.

The warehouse models expect web-analytics events, game schedules, shop exports and
vault feeds. Each function below states how such a table is read off the given ones;
all are narrow projections unless noted, so filters on them reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.values import money
from granary.sources.tables import table

HIGH_DATE = "9999-12-31"


def _c(name: str) -> Column:
    return F.col(name)


def games(spark: SparkSession, root: str) -> DataFrame:
    """Schedule of games, one per order; every 97th has no start yet."""
    o = table(spark, root, "orders").selectExpr(
        "*",
        """case when o_orderkey % 97 <> 0
           then o_orderdate + make_dt_interval(0, 0, cast(o_orderkey * 37 % 1440 as int)) end as startTime""",
        "concat('t', o_custkey % 30) as homeTeamId",
        "concat('t', (o_custkey + 1 + o_orderkey % 29) % 30) as awayTeamId",
        "cast(o_orderkey % 120 + 120 as int) as duration_minutes",
    )
    return o.selectExpr(
        "concat('g', o_orderkey) as gameId", "1 as gameNumber", "concat('s', year(o_orderdate)) as seasonId",
        "year(o_orderdate) as year", "'REG' as type",
        "case when hour(startTime) < 17 then 'D' when hour(startTime) >= 17 then 'N' end as dayNight",
        "format_string('%d:%02d', duration_minutes div 60, duration_minutes % 60) as duration", "duration_minutes",
        "homeTeamId", "concat('Team ', homeTeamId) as homeTeamName", "awayTeamId", "concat('Team ', awayTeamId) as awayTeamName",
        "startTime", "cast(floor(o_totalprice / 10) as bigint) as attendance", "o_orderstatus as status", "o_orderdate as created",
    )


def _event_parts(spark: SparkSession, root: str) -> DataFrame:
    """Events with their parsed property, the user's country and the device in use."""
    # nation and region are 25 and 5 rows; Spark sees their size and broadcasts.
    geo = table(spark, root, "nation").join(table(spark, root, "region"), F.expr("n_regionkey = r_regionkey"), "left")
    e = table(spark, root, "events").join(geo, F.expr("user_id % 25 = n_nationkey"), "left")
    e = e.selectExpr(
        "event_id", "ts", "user_id", "event_type", "value", "n_name", "r_name",
        "cast(get_json_object(props, '$.k') as bigint) as k",
        "element_at(array('desktop', 'mobile', 'tablet'), cast((user_id + day(ts) div 10) % 3 + 1 as int)) as category",
    )
    return e.selectExpr("*", "case category when 'desktop' then 'Windows' when 'mobile' then 'Android' else 'iOS' end as os")


EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def ga4_events(spark: SparkSession, root: str) -> DataFrame:
    """Nested web-analytics events: structs for device, geo, app, shop; key/value params."""

    def number(key: str, value: str) -> str:
        return f"named_struct('key', '{key}', 'value', named_struct('int_value', {value}, 'string_value', cast(null as string)))"

    def text(key: str, value: str) -> str:
        return f"named_struct('key', '{key}', 'value', named_struct('int_value', cast(null as bigint), 'string_value', {value}))"

    params = ", ".join([
        number("ga_session_id", "k % 5"), number("engagement_time_msec", "k * 100"), number("ga_session_number", "k % 3"),
        text("page_location", "concat('/p/', k % 20)"), text("page_title", "concat('Page ', k % 20)"),
    ])
    return _event_parts(spark, root).selectExpr(
        "date_format(ts, 'yyyyMMdd') as event_date",
        f"timestampdiff(MICROSECOND, {EPOCH}, ts) as event_timestamp",
        "event_type as event_name",
        "case when user_id % 3 <> 0 then concat('id', user_id) end as user_id",
        "concat('u', user_id) as user_pseudo_id",
        "1704067200000000 + user_id * 1000000 as user_first_touch_timestamp",
        "'WEB' as platform",
        """named_struct('category', category, 'operating_system', os, 'operating_system_version', concat('v', user_id % 4),
             'web_info', named_struct('browser', if(user_id % 2 = 0, 'Chrome', 'Safari'), 'browser_version', concat('b', user_id % 5)),
             'language', case when user_id % 7 <> 0 then concat('lang', user_id % 3) end, 'is_limited_ad_tracking', 'No',
             'mobile_brand_name', case when category = 'mobile' then 'Google' end,
             'mobile_model_name', case when category = 'mobile' then concat('Pixel ', user_id % 6) end) as device""",
        """named_struct('continent', r_name, 'sub_continent', concat('Sub ', r_name), 'country', n_name,
             'region', concat('R', user_id % 4), 'city', case when user_id % 11 <> 0 then concat('C', user_id % 8) end) as geo""",
        """named_struct('id', case when user_id % 5 = 0 then concat('app', user_id % 2) end,
             'version', case when user_id % 5 = 0 then '1.0' end,
             'firebase_app_id', case when user_id % 5 = 0 then concat('fb', user_id % 4) end) as app_info""",
        f"array({params}) as event_params",
        """named_struct('total_item_quantity', case when event_type = 'purchase' then k % 4 end,
             'purchase_revenue', case when event_type = 'purchase' then cast(value as decimal(18,2)) end,
             'transaction_id', case when event_type = 'purchase' then concat('tx', event_id) end) as ecommerce""",
    )


def ga_sessions(spark: SparkSession, root: str, first_visits: bool = True) -> DataFrame:
    """Visits with nested totals, device and network; `dt` is the date shard.

    `newVisits` is 1 on a visitor's first visit only, found by one pre-aggregated
    minimum per visitor that joins back on the key. Readers that do not use it leave
    the join out with `first_visits=False`; it is then null.
    """
    e = _event_parts(spark, root)
    if first_visits:
        first = table(spark, root, "events").groupBy(F.col("user_id").alias("first_user")).agg(F.min("ts").alias("first_ts"))
        e = e.join(first, F.expr("user_id = first_user"), "left")
    else:
        e = e.withColumn("first_ts", F.lit(None).cast("timestamp_ntz"))
    return e.selectExpr(
        "cast(user_id as string) as fullVisitorId",
        f"timestampdiff(SECOND, {EPOCH}, ts) as visitStartTime",
        "event_id as visitId",
        "date_format(ts, 'yyyyMMdd') as dt",
        """named_struct('visits', 1, 'hits', cast(k as int), 'pageviews', cast(k % 10 as int),
             'timeOnSite', cast(floor(value) as int), 'newVisits', case when ts = first_ts then 1 end) as totals""",
        """named_struct('browser', if(user_id % 2 = 0, 'Chrome', 'Safari'), 'operatingSystem', os,
             'deviceCategory', category, 'isMobile', category = 'mobile') as device""",
        "named_struct('continent', r_name, 'subContinent', concat('Sub ', r_name), 'country', n_name) as geoNetwork",
    )


def partsupp(spark: SparkSession, root: str) -> DataFrame:
    """Distinct (part, supplier) pairs of the order lines with quantity and cost."""
    return stock_of(table(spark, root, "lineitem").select("l_partkey", "l_suppkey").distinct())


def stock_of(pairs: DataFrame) -> DataFrame:
    """The `partsupp` row of each (l_partkey, l_suppkey), row by row: quantity and cost follow from the keys."""
    part, supp = _c("l_partkey"), _c("l_suppkey")
    cents = (part * 13 + supp) % 100000
    return pairs.select(
        part.alias("ps_partkey"),
        supp.alias("ps_suppkey"),
        ((part * 7 + supp) % 9999 + 1).alias("ps_availqty"),
        (cents.cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)").alias("ps_supplycost"),
    )


def payments(spark: SparkSession, root: str) -> DataFrame:
    """Payments, one per order line; amount in cents."""
    method = F.element_at(
        F.array(*[F.lit(m) for m in ("credit_card", "coupon", "bank_transfer", "gift_card")]),
        (_c("l_linenumber") % 4 + 1).cast("int"),
    )
    cents = (money("l_extendedprice") * F.lit(100).cast("decimal(3,0)")).cast("bigint")
    return table(spark, root, "lineitem").select(
        _c("l_orderkey").alias("order_id"), method.alias("payment_method"), cents.alias("amount")
    )


# --- shop exports -----------------------------------------------------------------


def shop_customers(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "customer").select(_c("c_custkey").alias("id"), _c("c_name").alias("name"))


def shop_stores(spark: SparkSession, root: str) -> DataFrame:
    key = _c("s_suppkey")
    opened = F.concat(
        F.lit("20"), F.lpad((key % 79 + 1).cast("string"), 2, "0"), F.lit("-0"), (key % 9 + 1).cast("string"),
        F.lit("-1"), (key % 10).cast("string"), F.lit("T23:59:59.9999"),
    )
    return table(spark, root, "supplier").select(
        key.alias("id"), _c("s_name").alias("name"), opened.alias("opened_at"),
        ((key % 9).cast("decimal(4,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(6,4)").alias("tax_rate"),
    )


def shop_products(spark: SparkSession, root: str) -> DataFrame:
    key = _c("p_partkey")
    kind = F.when(key % 5 != 0, F.when(key % 2 == 0, "jaffle").otherwise("beverage"))
    return table(spark, root, "part").select(
        key.alias("sku"), _c("p_name").alias("name"), kind.alias("type"),
        (money("p_retailprice") * F.lit(100).cast("decimal(3,0)")).cast("bigint").alias("price"),
        _c("p_type").alias("description"),
    )


def shop_supplies(spark: SparkSession, root: str) -> DataFrame:
    ps = partsupp(spark, root)
    return ps.select(
        _c("ps_suppkey").alias("id"),
        F.concat(F.lit("supply "), _c("ps_suppkey")).alias("name"),
        (_c("ps_supplycost") * F.lit(100).cast("decimal(3,0)")).cast("bigint").alias("cost"),
        (_c("ps_suppkey") % 2 == 0).alias("perishable"),
        _c("ps_partkey").alias("sku"),
    )


def shop_orders(spark: SparkSession, root: str) -> DataFrame:
    """Orders with subtotal, tax and total in cents, summed from the lines."""
    cents = (money("l_extendedprice") * F.lit(100).cast("decimal(3,0)")).cast("bigint")
    tax_pct = (_c("l_tax").cast("decimal(4,2)") * F.lit(100).cast("decimal(3,0)")).cast("bigint")
    lines = (
        table(spark, root, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sum(cents).alias("subtotal"), F.sum(F.floor(cents * tax_pct / 100)).alias("tax_paid"))
    )
    o = table(spark, root, "orders")
    return o.join(lines, _c("o_orderkey") == _c("l_orderkey"), "inner").select(
        _c("o_orderkey").alias("id"),
        (_c("o_custkey") % 100).alias("store_id"),
        _c("o_custkey").alias("customer"),
        "subtotal", _c("tax_paid").cast("bigint").alias("tax_paid"),
        (_c("subtotal") + _c("tax_paid")).cast("bigint").alias("order_total"),
        (_c("o_orderdate") + F.make_dt_interval(hours=(_c("o_orderkey") % 24).cast("int"))).alias("ordered_at"),
    )


def shop_items(spark: SparkSession, root: str) -> DataFrame:
    """Order lines as items; the id is built from the line's own columns."""
    item = F.concat_ws(
        "-", _c("l_orderkey"), _c("l_linenumber"), _c("l_partkey"), _c("l_suppkey"),
    )
    return table(spark, root, "lineitem").select(
        item.alias("id"), _c("l_orderkey").alias("order_id"), _c("l_partkey").alias("sku"),
    )


# --- graphs -----------------------------------------------------------------------

SUPPLIER_BASE = 1_000_000_000
NATION_BASE = 2_000_000_000


def supply_edges(spark: SparkSession, root: str) -> DataFrame:
    """Bipartite part - supplier edges, weight = smallest ordered quantity."""
    return (
        table(spark, root, "lineitem")
        .groupBy(_c("l_partkey").alias("src"), (_c("l_suppkey") + SUPPLIER_BASE).alias("dst"))
        .agg(F.min(_c("l_quantity").cast("bigint")).alias("weight"))
    )


def market_edges(spark: SparkSession, root: str) -> DataFrame:
    """Customers and suppliers joined to their nation: one component per nation."""
    c = table(spark, root, "customer").select(_c("c_custkey").alias("src"), (_c("c_nationkey") + NATION_BASE).alias("dst"))
    s = table(spark, root, "supplier").select((_c("s_suppkey") + SUPPLIER_BASE).alias("src"), (_c("s_nationkey") + NATION_BASE).alias("dst"))
    return c.unionByName(s)


def part_tree(spark: SparkSession, root: str) -> DataFrame:
    """Parent -> child edges of a tree of parts with root 1."""
    p = table(spark, root, "part").where(_c("p_partkey") > 1)
    return p.select(F.floor(_c("p_partkey") / 2).cast("bigint").alias("src"), _c("p_partkey").alias("dst"))


def part_dag(spark: SparkSession, root: str) -> DataFrame:
    """Parent -> child edges where a part depends on its half and its third."""
    p = table(spark, root, "part").where(_c("p_partkey") > 1)
    key = _c("p_partkey")
    parents = F.array_distinct(F.array(F.floor(key / 2), F.greatest(F.floor(key / 3), F.lit(1)))).cast("array<bigint>")
    return p.select(F.explode(parents).alias("src"), key.alias("dst"))


# --- vault feeds ------------------------------------------------------------------

FIRST_LOAD = "1997-12-31"
SECOND_LOAD = "2001-12-31"


def vault_orders(spark: SparkSession, root: str, load: int | None = None, order_date: str | None = None) -> DataFrame:
    """Order feed of one load (1 = orders up to 1997, 2 = later) or of one day.

    Both choices are ranges on `o_orderdate`, so they are pushed into the scan.
    """
    o = table(spark, root, "orders")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    if load == 1:
        o = o.where(_c("o_orderdate") < cut)
    elif load == 2:
        o = o.where(_c("o_orderdate") >= cut)
    if order_date is not None:
        day = F.lit(order_date).cast("timestamp_ntz")
        o = o.where((_c("o_orderdate") >= day) & (_c("o_orderdate") < day + F.expr("interval 1 day")))
    return o


def vault_customers(spark: SparkSession, root: str, load: int | None = None) -> DataFrame:
    """Customer feed; in the second load every fifth customer's balance is one higher."""
    c = table(spark, root, "customer")
    balance = money("c_acctbal")
    if load == 2:
        balance = F.when(_c("c_custkey") % 5 == 0, (balance + 1).cast("decimal(18,2)")).otherwise(balance)
    return c.select(
        "c_custkey", "c_name", "c_nationkey", balance.alias("c_acctbal"), "c_mktsegment",
        F.concat(F.lit("p"), _c("c_custkey")).alias("c_phone"),
    )
