"""Shop marts: customers, payments, items, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.hashing import surrogate_key
from granary.functions.values import cents_to_dollars
from granary.operators.ordered import keyed_row_number
from granary.plans.duck import with_
from granary.plans.registry import query
from granary.sources import adapters as A
from granary.sources.tables import table

# --- first shop -------------------------------------------------------------------


def customers_v1(spark: SparkSession, root: str) -> DataFrame:
    """Customers with first and last order date and the number of orders, zero when none."""
    c = table(spark, root, "customer").selectExpr("c_custkey as customer_id", "concat('First', c_custkey % 50) as first_name", "c_name as last_name")
    o = table(spark, root, "orders").selectExpr("o_orderkey as order_id", "o_custkey as customer_id", "to_date(o_orderdate) as order_date")
    per = o.groupBy("customer_id").agg(
        F.min("order_date").alias("first_order_date"), F.max("order_date").alias("most_recent_order_date"), F.count("order_id").alias("number_of_orders"))
    return c.join(per, "customer_id", "left").withColumn("number_of_orders", F.coalesce("number_of_orders", F.lit(0)))


query("jaffle_customers_v1", """select c_custkey as customer_id, 'First'||(c_custkey%50) as first_name, c_name as last_name, cast(min(o_orderdate) as date) as first_order_date,
  cast(max(o_orderdate) as date) as most_recent_order_date, count(o_orderkey) as number_of_orders from customer left join orders on o_custkey=c_custkey group by 1,2,3""")(customers_v1)


def payment_pivot(spark: SparkSession, root: str) -> DataFrame:
    """One amount column per payment method found in the data."""
    p = A.payments(spark, root).groupBy("order_id").pivot("payment_method").agg(F.sum("amount"))
    return p.select("order_id", *[F.col(c).alias(f"{c}_amount") for c in p.columns if c != "order_id"])


_PIVOT = with_("payments", " select order_id, " + ", ".join(
    f"cast(sum(case when payment_method='{m}' then amount end) as bigint) as {m}_amount" for m in ("credit_card", "coupon", "bank_transfer", "gift_card")) + " from payments group by 1")
query("jaffle_payment_pivot", _PIVOT)(payment_pivot)

# --- second shop: staging ----------------------------------------------------------


def stg_customers(spark: SparkSession, root: str) -> DataFrame:
    return A.shop_customers(spark, root).selectExpr("id as customer_id", "name as customer_name")


def stg_locations(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("location_id"), F.col("name").alias("location_name"), "tax_rate",
                     F.to_date(F.to_timestamp_ntz("opened_at")).alias("opened_date"))


def stg_products(df: DataFrame) -> DataFrame:
    flag = lambda kind: F.coalesce(F.col("type") == kind, F.lit(False))
    return df.select(
        F.col("sku").alias("product_id"), F.col("name").alias("product_name"), F.col("type").alias("product_type"),
        F.col("description").alias("product_description"), cents_to_dollars("price").alias("product_price"),
        flag("jaffle").alias("is_food_item"), flag("beverage").alias("is_drink_item"))


def stg_supplies(df: DataFrame) -> DataFrame:
    return df.select(
        surrogate_key(df, ["id", "sku"]).alias("supply_uuid"), F.col("id").alias("supply_id"), F.col("sku").alias("product_id"),
        F.col("name").alias("supply_name"), cents_to_dollars("cost").alias("supply_cost"), F.col("perishable").alias("is_perishable_supply"))


def stg_items(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("order_item_id"), "order_id", F.col("sku").alias("product_id"))


def stg_orders(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("id").alias("order_id"), F.col("store_id").alias("location_id"), F.col("customer").alias("customer_id"),
        F.col("subtotal").alias("subtotal_cents"), F.col("tax_paid").alias("tax_paid_cents"), F.col("order_total").alias("order_total_cents"),
        cents_to_dollars("subtotal").alias("subtotal"), cents_to_dollars("tax_paid").alias("tax_paid"),
        cents_to_dollars("order_total").alias("order_total"), F.to_date("ordered_at").alias("order_date"))


query("jaffle_stg_customers", "select c_custkey as customer_id, c_name as customer_name from customer")(stg_customers)
query("jaffle_stg_locations", """select s_suppkey as location_id, s_name as location_name, cast((s_suppkey%9)/100.0 as decimal(6,4)) as tax_rate,
  make_date(2000+cast(s_suppkey%79+1 as integer), cast(s_suppkey%9+1 as integer), cast(10+s_suppkey%10 as integer)) as opened_date from supplier""")(
    lambda spark, root: stg_locations(A.shop_stores(spark, root)))
query("jaffle_stg_products", with_("shop_products", " select * from shop_products"))(lambda spark, root: stg_products(A.shop_products(spark, root)))
query("jaffle_stg_supplies", with_("shop_supplies", " select * from shop_supplies"))(lambda spark, root: stg_supplies(A.shop_supplies(spark, root)))
query("jaffle_stg_order_items", with_("shop_items", " select * from shop_items"))(lambda spark, root: stg_items(A.shop_items(spark, root)))
query("stg_rename", with_("shop_orders", " select * from shop_orders"))(lambda spark, root: stg_orders(A.shop_orders(spark, root)))

# --- second shop: marts ------------------------------------------------------------


def order_items(items: DataFrame, orders: DataFrame, products: DataFrame, supplies: DataFrame) -> DataFrame:
    """Items with order date, product details and the supply cost of the product.

    Supplies are summed per product before the join, so the join never multiplies items.
    """
    cost = supplies.groupBy("product_id").agg(F.sum("supply_cost").cast("decimal(26,2)").alias("supply_cost"))
    return (
        items.join(orders.select("order_id", "order_date"), "order_id", "left")
        .join(products.select("product_id", "product_name", "product_price", "is_food_item", "is_drink_item"), "product_id", "left")
        .join(cost, "product_id", "left")
    )


def order_mart(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders with cost, item counts, food and drink flags, and the customer's order number.

    The number is found on the orders alone, before the item totals make the rows wide.
    """
    numbered = keyed_row_number(orders, "customer_id", [F.col("order_date"), F.col("order_id")], "customer_order_number")
    per = items.groupBy("order_id").agg(
        F.sum("supply_cost").cast("decimal(38,2)").alias("order_cost"), F.sum("product_price").cast("decimal(26,2)").alias("order_items_subtotal"),
        F.count("order_item_id").alias("count_order_items"),
        F.sum(F.when(F.col("is_food_item"), 1).otherwise(0)).alias("count_food_items"),
        F.sum(F.when(F.col("is_drink_item"), 1).otherwise(0)).alias("count_drink_items"))
    return numbered.join(per, "order_id", "left").withColumns({
        "is_food_order": F.col("count_food_items") > 0, "is_drink_order": F.col("count_drink_items") > 0})


def customer_mart(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers with lifetime orders and spend; more than one order makes a returning customer."""
    per = orders.groupBy("customer_id").agg(
        F.countDistinct("order_id").alias("count_lifetime_orders"), F.min("order_date").alias("first_order_date"), F.max("order_date").alias("last_order_date"),
        *[F.sum(c).cast("decimal(26,2)").alias(n) for c, n in (("subtotal", "lifetime_spend_pretax"), ("tax_paid", "lifetime_tax_paid"), ("order_total", "lifetime_spend"))])
    kind = F.when(F.col("count_lifetime_orders") > 1, "returning").otherwise("new")
    return customers.join(per, "customer_id", "left").withColumn("customer_type", kind)


def _order_items(spark: SparkSession, root: str) -> DataFrame:
    return order_items(stg_items(A.shop_items(spark, root)), stg_orders(A.shop_orders(spark, root)),
                       stg_products(A.shop_products(spark, root)), stg_supplies(A.shop_supplies(spark, root)))


_ITEMS = """, oi as (select i.*, order_date, product_name, product_price, is_food_item, is_drink_item, supply_cost from shop_items i
  left join shop_orders o on o.order_id=i.order_id left join shop_products p on p.product_id=i.product_id
  left join (select product_id, cast(sum(supply_cost) as decimal(26,2)) as supply_cost from shop_supplies group by 1) s on s.product_id=i.product_id)"""
_NEED = "shop_items shop_orders shop_products shop_supplies"
query("jaffle_order_items", with_(_NEED, _ITEMS + " select * from oi"))(_order_items)
query("jaffle_orders", with_(_NEED, _ITEMS + """, s as (select order_id, cast(sum(supply_cost) as decimal(38,2)) as order_cost, cast(sum(product_price) as decimal(26,2)) as order_items_subtotal,
  count(order_item_id) as count_order_items, cast(sum(case when is_food_item then 1 else 0 end) as bigint) as count_food_items,
  cast(sum(case when is_drink_item then 1 else 0 end) as bigint) as count_drink_items from oi group by 1)
select o.*, s.* exclude (order_id), count_food_items>0 as is_food_order, count_drink_items>0 as is_drink_order,
  cast(row_number() over (partition by customer_id order by order_date, o.order_id) as integer) as customer_order_number from shop_orders o left join s on s.order_id=o.order_id"""))(
    lambda spark, root: order_mart(stg_orders(A.shop_orders(spark, root)), _order_items(spark, root)))
query("jaffle_customers_v2", with_("shop_orders", """, s as (select customer_id, count(distinct order_id) as count_lifetime_orders, min(order_date) as first_order_date, max(order_date) as last_order_date,
  cast(sum(subtotal) as decimal(26,2)) as lifetime_spend_pretax, cast(sum(tax_paid) as decimal(26,2)) as lifetime_tax_paid, cast(sum(order_total) as decimal(26,2)) as lifetime_spend from shop_orders group by 1)
select c_custkey as customer_id, c_name as customer_name, s.* exclude (customer_id), case when count_lifetime_orders>1 then 'returning' else 'new' end as customer_type
from customer left join s on customer_id=c_custkey"""))(
    lambda spark, root: customer_mart(stg_customers(spark, root), stg_orders(A.shop_orders(spark, root))))
