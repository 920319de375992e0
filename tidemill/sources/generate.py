"""Seeded test data: tenants of unequal weight, customers, products, orders, items, a
click stream and a change log. Every value is a hash of (seed, row id), so tables are
the same on any cluster, any day and any number of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The domains of coded columns.
STATUSES = ["COMPLETE", "COMPLETE", "COMPLETE", "PENDING", "CANCELLED", "RETURNED"]
CURRENCIES = ["USD", "USD", "USD", "EUR", "GBP"]
PAYMENTS = ["PAID", "PAID", "PAID", "FAILED", "REFUNDED"]
SHIPPING = [0.0, 0.0, 4.99, 9.99]
EVENT_TYPES = ["view", "view", "view", "click", "add_to_cart", "search", "purchase"]
DEVICES = ["mobile", "mobile", "desktop", "tablet"]


def uniform(seed: int, what: str, *ids: Column) -> Column:
    """A number in [0, 1) that depends on the seed, a name and the row's ids only."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *ids), F.lit(1 << 40)) / float(1 << 40)


def pick(values: list, u: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.floor(u * len(values)) + 1).cast("int"))


def pick_weighted(shares: dict[str, float], u: Column) -> Column:
    """A key by cumulative share; the last one takes what rounding leaves."""
    total, below, out = sum(shares.values()), 0, None
    for name, share in list(shares.items())[:-1]:
        below += share
        out = F.when(u < below / total, name) if out is None else out.when(u < below / total, name)
    return F.lit(list(shares)[-1]) if out is None else out.otherwise(list(shares)[-1])


def tenant_shares(count: int = 12, largest: float = 0.6, decay: float = 0.75) -> dict[str, float]:
    """Tenants of unequal weight: the first has `largest` of all rows, the others share
    the rest, each with `decay` times as much as the one before."""
    weights = [decay**k for k in range(count - 1)]
    shares = [largest, *((1 - largest) * w / sum(weights) for w in weights)] if weights else [1.0]
    return {f"t_{k:03d}": share for k, share in enumerate(shares)}


SHARES = tenant_shares()


def tier(share: float) -> str:
    return "large" if share >= 0.25 else "medium" if share >= 0.05 else "small"


def tenants(spark: SparkSession, shares: dict[str, float] = SHARES) -> DataFrame:
    return spark.createDataFrame([(t, f"Tenant {t.removeprefix('t_')}", tier(share), "2023-01-01") for t, share in shares.items()], "tenant_id string, tenant_name string, tier string, signup_date string")


def customers(spark: SparkSession, n: int, seed: int = 42, shares: dict[str, float] = SHARES) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(
        pick_weighted(shares, uniform(seed, "tenant", i)).alias("tenant_id"),
        F.format_string("c_%07d", i).alias("customer_id"),
        F.format_string("Customer %d", i).alias("name"),
        F.format_string("c%d@example.com", i).alias("email"),
        pick(["US", "DE", "FR", "GB"], uniform(seed, "country", i)).alias("country"),
        F.date_add(F.lit("2023-01-01").cast("date"), (uniform(seed, "signup", i) * 700).cast("int")).alias("signup_date"),
    )


def products(spark: SparkSession, per_tenant: int = 200, seed: int = 42, shares: dict[str, float] = SHARES, categories: int = 8) -> DataFrame:
    """product_id repeats across tenants on purpose: only (tenant_id, product_id) is a key."""
    rows = spark.range(per_tenant).crossJoin(F.broadcast(tenants(spark, shares).select("tenant_id")))
    i, t = F.col("id"), F.col("tenant_id")
    return rows.select(t, F.format_string("p_%04d", i).alias("product_id"), F.format_string("Product %d", i).alias("product_name"), F.format_string("category_%d", F.floor(uniform(seed, "category", t, i) * categories)).alias("category"), F.round(5 + uniform(seed, "price", t, i) * 195, 2).alias("base_price"))


def orders(spark: SparkSession, n: int, n_customers: int, seed: int = 42, start: str = "2026-01-01", days: int = 180, shares: dict[str, float] = SHARES) -> DataFrame:
    """Orders with total = subtotal + 8 % tax + shipping, placed by customers of the
    customers() table with the same seed and count."""
    i = F.col("id")
    buyer = F.floor(uniform(seed, "buyer", i) * n_customers).cast("long")
    seconds = F.floor(uniform(seed, "time", i) * days * 86400).cast("long")
    rows = spark.range(n).withColumns({"buyer": buyer, "ts": F.timestamp_seconds(F.unix_timestamp(F.lit(f"{start} 00:00:00").cast("timestamp")) + seconds), "subtotal": F.round(5 + uniform(seed, "subtotal", i) * 495, 2), "shipping": pick(SHIPPING, uniform(seed, "shipping", i))})
    rows = rows.withColumn("tax", F.round(F.col("subtotal") * 0.08, 2))
    return rows.select(
        pick_weighted(shares, uniform(seed, "tenant", F.col("buyer"))).alias("tenant_id"), F.format_string("o_%09d", i).alias("order_id"), F.format_string("c_%07d", "buyer").alias("customer_id"),
        F.col("ts").alias("order_ts"), F.to_date("ts").alias("order_date"), pick(STATUSES, uniform(seed, "status", i)).alias("status"), pick(CURRENCIES, uniform(seed, "currency", i)).alias("currency"),
        "subtotal", "tax", "shipping", F.round(F.col("subtotal") + F.col("tax") + F.col("shipping"), 2).alias("total_amount"), pick(PAYMENTS, uniform(seed, "payment", i)).alias("payment_status"),
    )


def order_items(order_rows: DataFrame, per_tenant: int = 200, seed: int = 42, most: int = 4) -> DataFrame:
    """One to `most` items for each order."""
    o = F.col("order_id")
    lines = order_rows.select("tenant_id", "order_id", F.explode(F.sequence(F.lit(1), (1 + F.floor(uniform(seed, "lines", o) * most)).cast("int"))).alias("line"))
    line = F.col("line")
    lines = lines.withColumns({"quantity": (1 + F.floor(uniform(seed, "quantity", o, line) * 5)).cast("int"), "unit_price": F.round(5 + uniform(seed, "unit", o, line) * 95, 2)})
    return lines.select("tenant_id", "order_id", F.concat_ws("_", "order_id", "line").alias("order_item_id"), F.format_string("p_%04d", F.floor(uniform(seed, "product", o, line) * per_tenant)).alias("product_id"), "quantity", "unit_price", F.round(F.col("quantity") * F.col("unit_price"), 2).alias("item_revenue"))


def make_dirty(order_rows: DataFrame, share: float = 0.02, seed: int = 42) -> DataFrame:
    """Damage a share of the orders in one of five ways: no customer, negative total, no
    date, an appended duplicate, or an arrival 30 to 200 days before the window."""
    o = F.col("order_id")
    kind = F.when(uniform(seed, "dirty", o) < share, F.floor(uniform(seed, "kind", o) * 5).cast("int"))
    rows = order_rows.withColumn("_kind", kind)
    back = -(30 + F.floor(uniform(seed, "late", o) * 171)).cast("int")
    damaged = rows.withColumns({
        "customer_id": F.when(F.col("_kind") == 0, None).otherwise(F.col("customer_id")),
        "total_amount": F.when(F.col("_kind") == 1, -F.col("total_amount")).otherwise(F.col("total_amount")),
        "order_date": F.when(F.col("_kind") == 2, None).when(F.col("_kind") == 4, F.date_add("order_date", back)).otherwise(F.col("order_date")),
    })
    return damaged.unionByName(damaged.filter("_kind = 3")).drop("_kind")


def clicks(spark: SparkSession, n: int, start: str = "2026-07-04 12:00:00", span_seconds: int = 600, seed: int = 7) -> DataFrame:
    i = F.col("id")
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + F.floor(uniform(seed, "ts", i) * span_seconds).cast("long"))
    return spark.range(n).select(
        pick_weighted(SHARES, uniform(seed, "tenant", i)).alias("tenant_id"), F.format_string("e_%09d", i).alias("event_id"), F.format_string("s_%06d", F.floor(uniform(seed, "session", i) * (n // 5 + 1))).alias("session_id"),
        F.format_string("c_%07d", F.floor(uniform(seed, "customer", i) * 1000)).alias("customer_id"), ts.alias("event_ts"), F.date_format(ts, "yyyy-MM-dd").alias("event_date"), pick(EVENT_TYPES, uniform(seed, "type", i)).alias("event_type"),
        F.format_string("p_%04d", F.floor(uniform(seed, "product", i) * 200)).alias("product_id"), F.format_string("/p/%d", i % 200).alias("page_url"), pick(DEVICES, uniform(seed, "device", i)).alias("device_type"),
    )


def change_log(order_rows: DataFrame, n_col: str = "n", base: str = "2026-07-04 00:00:00") -> DataFrame:
    """A change log for orders numbered by n_col: an insert each; an update after 5
    minutes for 60 %; another after 10 for 10 %; a delete after 15 for 8 %."""
    n, at = F.col(n_col), F.lit(base).cast("timestamp")
    event = lambda op, minutes, status, amount: F.struct(F.lit(op).alias("op"), (at + F.expr(f"INTERVAL {minutes} MINUTES")).alias("commit_ts"), (n * 4 + F.lit(minutes // 5)).cast("long").alias("seq"), status.cast("string").alias("status"), amount.cast("double").alias("total_amount"))
    none = F.lit(None)
    events = F.array(
        event("I", 0, F.lit("PENDING"), F.col("total_amount")),
        F.when(n % 10 < 6, event("U", 5, F.lit("COMPLETE"), F.col("total_amount"))),
        F.when(n % 10 == 0, event("U", 10, F.lit("RETURNED"), F.col("total_amount"))),
        F.when(n % 25 < 2, event("D", 15, none, none)),
    )
    return order_rows.select("tenant_id", "order_id", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("e.op", "e.commit_ts", "e.seq", "tenant_id", "order_id", "e.status", "e.total_amount")


def baskets(spark: SparkSession, sizes: list[int]) -> DataFrame:
    """(order_id, product_id): one order with k distinct products for each size k."""
    return spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "order_id long, k int").select("order_id", F.explode(F.sequence(F.lit(1), "k")).alias("product_id"))
