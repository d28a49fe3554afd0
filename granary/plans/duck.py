"""Text pieces of the check SQL (DuckDB dialect).

Each stand-in table of `sources.adapters` has a twin here, written on its own as a
common table expression. `with_(names, body)` puts the needed ones before a query.
"""

from __future__ import annotations


def hash_key(*texts: str) -> str:
    """md5 over the texts; null when all are null."""
    gone = " and ".join(f"({t}) is null" for t in texts)
    return f"case when not ({gone}) then {_digest(texts)} end"


def hash_diff(**named: str) -> str:
    """md5 over named texts in name order."""
    return _digest([named[n] for n in sorted(named)])


def _digest(texts) -> str:
    return "md5(" + " || '||' || ".join(f"coalesce(nullif(upper(trim(cast({t} as varchar))),''),'^^')" for t in texts) + ")"


def surrogate(*texts: str) -> str:
    return "md5(" + " || '-' || ".join(f"coalesce(cast({t} as varchar),'_null_')" for t in texts) + ")"


def sha_b64(*texts: str) -> str:
    joined = " || '-' || ".join(f"coalesce(cast({t} as varchar),'')" for t in texts)
    return f"to_base64(unhex(sha256({joined})))"


MONEY = "decimal(18,2)"


def money(c: str) -> str:
    return f"cast({c} as decimal(18,2))"


def fr(expr: str, places: int) -> str:
    scale = float(10 ** places)
    return f"floor(({expr})*{scale}+0.5)/{scale}"


_K = "cast(json_extract_string(props,'$.k') as bigint)"

CTE: dict[str, str] = {}

CTE["geo"] = "geo as (select n_nationkey, n_name, r_name from nation left join region on n_regionkey=r_regionkey)"

CTE["ev"] = f"""ev as (
  select event_id, ts, user_id, event_type, value, {_K} as k, n_name, r_name,
    case (user_id + day(ts)//10)%3 when 0 then 'desktop' when 1 then 'mobile' else 'tablet' end as category,
    case (user_id + day(ts)//10)%3 when 0 then 'Windows' when 1 then 'Android' else 'iOS' end as os
  from events left join geo on user_id%25 = n_nationkey)"""

CTE["ga4"] = """ga4 as (
  select cast(ts as date) as event_date, ts as event_timestamp, event_type as event_name,
    case when user_id%3<>0 then 'id'||user_id end as user_id, 'u'||user_id as user_pseudo_id,
    timestamp '2024-01-01' + to_seconds(user_id) as user_first_touch_timestamp,
    category as device_category, os as device_os, 'v'||(user_id%4) as device_os_version,
    case when user_id%2=0 then 'Chrome' else 'Safari' end as device_browser, 'b'||(user_id%5) as device_browser_version,
    case when user_id%7<>0 then 'lang'||(user_id%3) end as device_language, 'No' as device_is_limited_ad_tracking,
    case when category='mobile' then 'Google' end as device_mobile_brand_name,
    case when category='mobile' then 'Pixel '||(user_id%6) end as device_mobile_model_name,
    r_name as geo_continent, 'Sub '||r_name as geo_sub_continent, n_name as geo_country, 'R'||(user_id%4) as geo_region,
    case when user_id%11<>0 then 'C'||(user_id%8) end as geo_city,
    case when user_id%5=0 then 'app'||(user_id%2) end as app_id, case when user_id%5=0 then '1.0' end as app_version,
    case when user_id%5=0 then 'fb'||(user_id%4) end as firebase_app_id,
    k*100 as engagement_time_msec, k%5 as ga_session_id, k%3 as ga_session_number,
    '/p/'||(k%20) as page_location, 'Page '||(k%20) as page_title,
    case when event_type='purchase' then k%4 end as ecommerce_total_item_quantity,
    case when event_type='purchase' then cast(value as decimal(18,2)) end as ecommerce_purchase_revenue,
    case when event_type='purchase' then 'tx'||event_id end as ecommerce_transaction_id
  from ev)"""

CTE["visits"] = """visits as (
  select cast(ev.user_id as varchar) as visitor_id, date_trunc('second', ts) as access_timestamp, event_id as visit_id,
    strftime(ts,'%Y%m%d') as dt, cast(ts as date) as transaction_date, 1 as visits, cast(k as integer) as hits,
    cast(k%10 as integer) as pageviews, cast(floor(value) as integer) as time_on_site, ts = first_ts as is_new_visits,
    case when ev.user_id%2=0 then 'Chrome' else 'Safari' end as browser, os, category as device_category,
    category='mobile' as is_mobile, r_name as continent, 'Sub '||r_name as sub_continent, n_name as country
  from ev join (select user_id, min(ts) as first_ts from events group by 1) f on f.user_id = ev.user_id)"""

CTE["games"] = """games as (
  select 'g'||o_orderkey as "gameId", 1 as "gameNumber", 's'||year(o_orderdate) as "seasonId", cast(year(o_orderdate) as integer) as year,
    'REG' as type, case when st is null then null when hour(st)<17 then 'D' else 'N' end as "dayNight",
    printf('%d:%02d', (120+o_orderkey%120)//60, (120+o_orderkey%120)%60) as duration,
    cast(120+o_orderkey%120 as integer) as duration_minutes,
    't'||(o_custkey%30) as "homeTeamId", 'Team t'||(o_custkey%30) as "homeTeamName",
    't'||((o_custkey+1+o_orderkey%29)%30) as "awayTeamId", 'Team t'||((o_custkey+1+o_orderkey%29)%30) as "awayTeamName",
    st as "startTime", cast(floor(o_totalprice/10) as bigint) as attendance, o_orderstatus as status, o_orderdate as created
  from (select *, case when o_orderkey%97<>0 then o_orderdate + to_minutes((o_orderkey*37)%1440) end as st from orders) o)"""

CTE["ps"] = """ps as (
  select l_partkey as ps_partkey, l_suppkey as ps_suppkey, (l_partkey*7+l_suppkey)%9999+1 as ps_availqty,
    cast(((l_partkey*13+l_suppkey)%100000)/100.0 as decimal(18,2)) as ps_supplycost
  from (select distinct l_partkey, l_suppkey from lineitem) d)"""

CTE["payments"] = """payments as (
  select l_orderkey as order_id,
    case l_linenumber%4 when 0 then 'credit_card' when 1 then 'coupon' when 2 then 'bank_transfer' else 'gift_card' end as payment_method,
    cast(cast(l_extendedprice as decimal(18,2))*100 as bigint) as amount from lineitem)"""

CTE["shop_orders"] = """shop_orders as (
  select o_orderkey as order_id, o_custkey%100 as location_id, o_custkey as customer_id, subtotal as subtotal_cents,
    tax as tax_paid_cents, subtotal+tax as order_total_cents,
    cast(subtotal/100.0 as decimal(16,2)) as subtotal, cast(tax/100.0 as decimal(16,2)) as tax_paid,
    cast((subtotal+tax)/100.0 as decimal(16,2)) as order_total,
    cast(o_orderdate as date) as order_date
  from orders join (
    select l_orderkey, cast(sum(c) as bigint) as subtotal, cast(sum((c*t)//100) as bigint) as tax from (
      select l_orderkey, cast(cast(l_extendedprice as decimal(18,2))*100 as bigint) as c,
        cast(cast(l_tax as decimal(4,2))*100 as bigint) as t from lineitem) q group by 1) l on o_orderkey=l_orderkey)"""

CTE["shop_products"] = """shop_products as (
  select p_partkey as product_id, p_name as product_name,
    case when p_partkey%5<>0 then case when p_partkey%2=0 then 'jaffle' else 'beverage' end end as product_type,
    p_type as product_description, cast(p_retailprice as decimal(16,2)) as product_price,
    coalesce(p_partkey%5<>0 and p_partkey%2=0,false) as is_food_item, coalesce(p_partkey%5<>0 and p_partkey%2=1,false) as is_drink_item
  from part)"""

CTE["shop_supplies"] = f"""shop_supplies as (
  select {surrogate('ps_suppkey', 'ps_partkey')} as supply_uuid, ps_suppkey as supply_id, ps_partkey as product_id,
    'supply '||ps_suppkey as supply_name, cast(ps_supplycost as decimal(16,2)) as supply_cost, ps_suppkey%2=0 as is_perishable_supply
  from ps)"""

CTE["shop_items"] = """shop_items as (
  select l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey as order_item_id, l_orderkey as order_id, l_partkey as product_id from lineitem)"""

CTE["supply_edges"] = """supply_edges as (
  select l_partkey as src, l_suppkey+1000000000 as dst, min(cast(l_quantity as bigint)) as weight from lineitem group by 1,2)"""

CTE["market_edges"] = """market_edges as (
  select c_custkey as src, cast(c_nationkey as bigint)+2000000000 as dst from customer
  union all select s_suppkey+1000000000, cast(s_nationkey as bigint)+2000000000 from supplier)"""

CTE["part_tree"] = "part_tree as (select p_partkey//2 as src, p_partkey as dst from part where p_partkey>1)"

CTE["part_dag"] = """part_dag as (
  select p_partkey//2 as src, p_partkey as dst from part where p_partkey>1
  union select greatest(p_partkey//3,1), p_partkey from part where p_partkey>1)"""

# --- vault --------------------------------------------------------------------------


def _vault_stage(load: int | None, name: str) -> str:
    where = {1: "where o_orderdate < timestamp '1998-01-01'", 2: "where o_orderdate >= timestamp '1998-01-01'", None: ""}[load]
    bal = "cast(c_acctbal as decimal(18,2))"
    if load == 2:
        bal = f"case when c_custkey%5=0 then cast({bal}+1 as decimal(18,2)) else {bal} end"
    day = "2001-12-31" if load in (2, None) else "1997-12-31"
    return f"""{name} as (
  select o_orderkey as orderkey, o_custkey as customerkey, o_orderstatus as orderstatus, {money('o_totalprice')} as totalprice,
    cast(o_orderdate as date) as orderdate, o_orderpriority as orderpriority,
    l_partkey as partkey, l_suppkey as supplierkey, l_linenumber as linenumber, {money('l_quantity')} as quantity,
    {money('l_extendedprice')} as extendedprice, {money('l_discount')} as discount, {money('l_tax')} as tax,
    l_returnflag as returnflag, l_linestatus as linestatus, cast(l_shipdate as date) as shipdate,
    case when o_orderstatus='O' then date '9999-12-31' else cast(l_shipdate as date)+cast(o_orderkey%30 as integer) end as commitdate,
    c_name as customer_name, 'p'||c_custkey as customer_phone, c_nationkey as customer_nation_key, {bal} as customer_accbal,
    c_mktsegment as customer_mktsegment, cn.n_name as customer_nation_name, cn.n_regionkey as customer_region_key,
    cr.r_name as customer_region_name, p_name as part_name, s_name as supplier_name,
    sn.n_name as supplier_nation_name, sr.r_name as supplier_region_name, date '{day}' as load_date
  from orders left join lineitem on l_orderkey=o_orderkey left join customer on o_custkey=c_custkey
    left join nation cn on c_nationkey=cn.n_nationkey left join region cr on cn.n_regionkey=cr.r_regionkey
    left join part on l_partkey=p_partkey left join supplier on l_suppkey=s_suppkey
    left join nation sn on s_nationkey=sn.n_nationkey left join region sr on sn.n_regionkey=sr.r_regionkey
  {where})"""


def _vault_inventory(orders: str, name: str, load: int | None) -> str:
    day = "2001-12-31" if load in (2, None) else "1997-12-31"
    return f"""{name} as (
  select ps_partkey as partkey, ps_suppkey as supplierkey, ps_availqty as availqty, ps_supplycost as supplycost,
    s.s_name as supplier_name, s_nationkey as supplier_nation_key, {money('s_acctbal')} as supplier_acctbal,
    pt.p_name as part_name, p_brand as part_brand, p_type as part_type, p_size as part_size, {money('p_retailprice')} as part_retailprice,
    n.n_name as supplier_nation_name, n.n_regionkey as supplier_region_key, r.r_name as supplier_region_name,
    date '{day}' as load_date
  from ps left join supplier s on ps_suppkey=s.s_suppkey left join part pt on ps_partkey=pt.p_partkey
    left join nation n on s_nationkey=n.n_nationkey left join region r on n.n_regionkey=r.r_regionkey
    join {orders} f on f.partkey=ps_partkey and f.supplierkey=ps_suppkey)"""


CTE["ro"] = _vault_stage(None, "ro")
CTE["ro1"] = _vault_stage(1, "ro1")
CTE["ro2"] = _vault_stage(2, "ro2")
CTE["ri"] = _vault_inventory("ro", "ri", None)
CTE["ri1"] = _vault_inventory("ro1", "ri1", 1)
CTE["ri2"] = _vault_inventory("ro2", "ri2", 2)

NEEDS = {
    "ev": ["geo"], "ga4": ["ev"], "visits": ["ev"], "shop_supplies": ["ps"],
    "ri": ["ro", "ps"], "ri1": ["ro1", "ps"], "ri2": ["ro2", "ps"],
}


def with_(names: str, body: str, recursive: bool = False) -> str:
    """`with <needed tables, in order> <body>`; body may start with further tables."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    body = body.strip()
    tables = ",\n".join(CTE[n] for n in order)
    lead = "with recursive " if recursive else "with "
    if body.startswith(","):
        return lead + tables + "\n" + body
    return lead + tables + "\n" + body
