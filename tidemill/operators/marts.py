"""Revenue marts: one definition each, used by the full, incremental and measured runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.exprs import exact_sum
from tidemill.operators.joins import enrich, keyed_join
from tidemill.operators.keyed import with_ranks
from tidemill.sources.tables import replace_window

COMPLETE = "COMPLETE"


def revenue_by_tenant(orders: DataFrame, status: str = COMPLETE, tenant: str = "tenant_id") -> DataFrame:
    """Order-grain revenue (with tax and shipping) of completed orders."""
    return orders.filter(F.col("status") == status).groupBy(tenant).agg(exact_sum("total_amount").alias("revenue"))


def daily_revenue(items: DataFrame, orders: DataFrame, products: DataFrame, status: str = COMPLETE, order_key: tuple[str, ...] = ("tenant_id", "order_id"), product_key: tuple[str, ...] = ("tenant_id", "product_id"), money: str = "decimal(18,2)") -> DataFrame:
    """Item-grain revenue, distinct orders and items sold by tenant, date and category.

    An item whose product is unknown counts under a null category; an item whose order
    is missing or not complete does not count. Orders are first folded to one row per
    order and group, which makes the exact distinct count a plain count and needs no
    further shuffle after the join on the order.
    """
    orders = orders.filter(F.col("status") == status).select("tenant_id", *[k for k in order_key if k != "tenant_id"], "order_date")
    items = items.select(*dict.fromkeys([*order_key, *product_key, "item_revenue"]))
    joined = keyed_join(items, orders, list(order_key))
    joined = enrich(joined, products.select(*product_key, "category"), list(product_key))
    group = ["tenant_id", "order_date", "category"]
    by_order = joined.groupBy(*[k for k in order_key if k != "tenant_id"], *group).agg(F.sum(F.col("item_revenue").cast(money)).alias("revenue"), F.count("*").alias("items"))
    return by_order.groupBy(*group).agg(F.sum("revenue").cast("double").alias("revenue"), F.count("*").alias("orders"), F.sum("items").alias("items_sold"))


def in_window(orders: DataFrame, start: str, end: str, column: str = "order_date") -> DataFrame:
    """Orders dated start..end, both included; the filter reaches the scan."""
    return orders.filter(F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def rebuild_daily_revenue(items: DataFrame, orders: DataFrame, products: DataFrame, path: str, start: str, end: str, **keys) -> DataFrame:
    """Rebuild the mart for start..end in place; running it again changes nothing."""
    mart = daily_revenue(items, in_window(orders, start, end), products, **keys)
    return replace_window(mart, path, "order_date", start, end)


def top_products(items: DataFrame, products: DataFrame, n: int = 5, group: tuple[str, ...] = ("tenant_id", "category"), product_key: tuple[str, ...] = ("tenant_id", "product_id")) -> DataFrame:
    """The n best-selling products of each group with their three ranks; ties in revenue
    are numbered by product."""
    revenue = items.groupBy(*product_key).agg(exact_sum("item_revenue").alias("revenue"))
    named = enrich(revenue, products.select(*product_key, "category", "product_name"), list(product_key), "inner")
    return with_ranks(named, list(group), [F.desc("revenue")], [F.col(product_key[-1])]).filter(F.col("row_number") <= n)


def share_of(mart: DataFrame, group: list[str], amount: str = "revenue") -> DataFrame:
    """mart with each row's share of its group's amount."""
    return mart.withColumn("share", F.col(amount) / F.sum(amount).over(Window.partitionBy(*group)))


def mart_total(mart: DataFrame, source: Column | None = None) -> DataFrame:
    """The mart's revenue as one exact sum."""
    return mart.agg(exact_sum(source if source is not None else F.col("revenue")).alias("revenue"))
