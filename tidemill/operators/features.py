"""Customer features as of a day, and the audit that shows what leaking the future does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.exprs import any_if, as_date, count_if, exact_sum, max_if, sum_if
from tidemill.operators.joins import fill_from

CUSTOMER = ["tenant_id", "customer_id"]


def lifetime_features(orders: DataFrame, as_of: str, status: str | None = "COMPLETE", key: list[str] = CUSTOMER, cut: bool = False) -> DataFrame:
    """Lifetime value by customer. With cut=False later orders count as well and
    recency can be negative; cut=True looks at orders up to the day only."""
    rows = orders if status is None else orders.filter(F.col("status") == status)
    day = as_date(as_of)
    if cut:
        rows = rows.filter(F.col("order_date") <= day)
    out = rows.groupBy(*key).agg(exact_sum("total_amount").alias("lifetime_revenue"), F.count("*").alias("lifetime_orders"), F.min("order_date").alias("first_order_date"), F.max("order_date").alias("last_order_date"))
    return out.withColumns({"avg_order_value": F.col("lifetime_revenue") / F.col("lifetime_orders"), "days_since_last_order": F.datediff(day, "last_order_date"), "as_of_date": day})


def point_in_time_features(customers: DataFrame, orders: DataFrame, as_of: str, days: tuple[int, ...] = (7, 30), status: str | None = "COMPLETE", key: list[str] = CUSTOMER) -> DataFrame:
    """One row per customer: revenue and orders of trailing windows (both ends included)
    and of the lifetime up to the day. Customers without orders have zeros and a null
    recency. Orders after the day are filtered at the scan, so nothing can leak."""
    day = as_date(as_of)
    rows = orders.filter(F.col("order_date") <= day)
    rows = rows if status is None else rows.filter(F.col("status") == status)
    measures = []
    for n in days:
        recent = F.col("order_date") >= F.date_sub(day, n)
        measures += [sum_if(recent, "total_amount").alias(f"revenue_{n}d"), count_if(recent).alias(f"orders_{n}d")]
    measures += [exact_sum("total_amount").alias("lifetime_revenue"), F.count("*").alias("lifetime_orders"), F.datediff(day, F.max("order_date")).alias("days_since_last_order")]
    zero = [f"{what}_{n}d" for n in days for what in ("revenue", "orders")] + ["lifetime_revenue", "lifetime_orders"]
    return fill_from(customers.select(*key), rows.groupBy(*key).agg(*measures), key, zero).withColumn("as_of_date", day)


def leakage_rows(orders: DataFrame, as_of: str, label_days: int = 30, status: str | None = "COMPLETE", key: list[str] = CUSTOMER) -> DataFrame:
    """By customer with an order up to the day: recency as known that day, recency with
    the future leaked in, and the label (bought within the next label_days)."""
    day, rows = as_date(as_of), orders if status is None else orders.filter(F.col("status") == status)
    after = (F.col("order_date") > day) & (F.col("order_date") <= F.date_add(day, label_days))
    out = rows.groupBy(*key).agg(max_if(F.col("order_date") <= day, "order_date").alias("known"), F.max("order_date").alias("leaked"), any_if(after).alias("label"))
    return out.filter(F.col("known").isNotNull()).select(*key, F.datediff(day, "known").alias("recency"), F.datediff(day, "leaked").alias("leaky_recency"), "label")


def leakage_by_label(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.round(F.avg("recency"), 1).alias("mean_recency"), F.round(F.avg("leaky_recency"), 1).alias("mean_leaky_recency"), F.count("*").alias("customers"))


def leakage_share(rows: DataFrame) -> DataFrame:
    """How many customers have a recency that only the future explains."""
    return rows.agg(F.count("*").alias("customers"), count_if(F.col("leaky_recency") < 0).alias("negative_leaky"), count_if(F.col("recency") < 0).alias("negative_known")).withColumn("negative_share", F.when(F.col("customers") > 0, F.col("negative_leaky") / F.col("customers")))
