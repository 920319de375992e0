"""The library's tables over the TPC-H-like test tables.

tenant_id is the customer's market segment, orders are complete when their status is
F, products are parts with the brand as category. These tables have single-column
ids, so their joins pass the id alone as key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.joins import enrich

STATUS = "F"
AS_OF = "2000-06-30"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("tenant_id"), F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.lit("1995-01-01").cast("date").alias("signup_date"))


def plain_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").cast("timestamp").alias("order_ts"), F.to_date("o_orderdate").alias("order_date"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total_amount"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the tenant of their customer."""
    return enrich(plain_orders(spark, sf_dir), customers(spark, sf_dir).select("customer_id", "tenant_id"), ["customer_id"], "inner")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("item_revenue"), F.col("l_suppkey").alias("supplier_id"), F.col("l_shipdate").alias("ship_ts"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("category"), F.col("p_retailprice").alias("base_price"))


def tenant_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as the order_items table has them; some lack a product or have a quantity of zero."""
    rows = enrich(items(spark, sf_dir), orders(spark, sf_dir).select("order_id", "tenant_id"), ["order_id"], "inner")
    text, k = (lambda c: F.col(c).cast("string")), F.col("order_id") + F.col("line")
    return rows.select(
        "tenant_id", text("order_id").alias("order_id"), F.concat(text("order_id"), F.lit("-"), text("line")).alias("order_item_id"),
        F.when(k % 41 != 0, text("product_id")).alias("product_id"), F.when(k % 43 == 0, 0).otherwise(F.col("quantity")).cast("int").alias("quantity"),
        (F.col("item_revenue") / F.col("quantity")).cast("double").alias("unit_price"), F.col("item_revenue").cast("double").alias("item_revenue"),
    )


def tenant_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products as the products table has them, the part type standing for a tenant; some lack a category."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("tenant_id"), k.cast("string").alias("product_id"), F.col("p_name").alias("product_name"), F.when(k % 37 != 0, F.col("p_brand")).alias("category"), F.col("p_retailprice").cast("double").alias("base_price"))


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with missing customers, negative totals, missing dates and appended
    copies; one row can have several problems."""
    k = F.col("order_id")
    rows = orders(spark, sf_dir).withColumns({
        "customer_id": F.when(k % 50 == 0, None).otherwise(F.col("customer_id")),
        "total_amount": F.when(k % 53 == 0, -F.col("total_amount")).otherwise(F.col("total_amount")),
        "order_date": F.when(k % 59 == 0, None).otherwise(F.col("order_date")),
    })
    return rows.unionByName(rows.filter(k % 61 == 0))


#: The same in SQL, as the start of a WITH clause.
SQL_ORDERS = """orders_t AS (
  SELECT c.c_mktsegment AS tenant_id, o.o_orderkey AS order_id, o.o_custkey AS customer_id, CAST(o.o_orderdate AS TIMESTAMP) AS order_ts,
         CAST(o.o_orderdate AS DATE) AS order_date, o.o_orderstatus AS status, o.o_totalprice AS total_amount
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""
SQL_DIRTY = SQL_ORDERS + """, damaged AS (
  SELECT tenant_id, order_id, CASE WHEN order_id % 50 = 0 THEN NULL ELSE customer_id END AS customer_id, order_ts,
         CASE WHEN order_id % 59 = 0 THEN NULL ELSE order_date END AS order_date, status,
         CASE WHEN order_id % 53 = 0 THEN -total_amount ELSE total_amount END AS total_amount
  FROM orders_t),
dirty AS (SELECT * FROM damaged UNION ALL SELECT * FROM damaged WHERE order_id % 61 = 0),
tagged AS (
  SELECT *, CASE WHEN tenant_id IS NULL THEN 'null_tenant' WHEN order_id IS NULL THEN 'null_order_id' WHEN customer_id IS NULL THEN 'null_customer'
                 WHEN order_date IS NULL THEN 'null_date' WHEN total_amount IS NULL OR total_amount < 0 THEN 'bad_total' END AS reason
  FROM dirty),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, order_id, reason IS NULL ORDER BY order_ts DESC, order_date, total_amount, customer_id) AS rn FROM tagged),
judged AS (
  SELECT tenant_id, order_id, customer_id, order_ts, order_date, status, total_amount,
         CASE WHEN reason IS NOT NULL THEN reason WHEN rn > 1 THEN 'duplicate' END AS rejection_reason
  FROM numbered)"""
SQL_MART = SQL_ORDERS + """, mart AS (
  SELECT o.tenant_id, o.order_date, p.p_brand AS category, CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
         count(DISTINCT l.l_orderkey) AS orders, count(*) AS items_sold
  FROM lineitem l JOIN orders_t o ON l.l_orderkey = o.order_id LEFT JOIN part p ON l.l_partkey = p.p_partkey
  WHERE o.status = 'F' GROUP BY ALL)"""
SQL_TENANT_ITEMS = """SELECT c_mktsegment AS tenant_id, CAST(l_orderkey AS VARCHAR) AS order_id, concat(l_orderkey, '-', l_linenumber) AS order_item_id,
  CASE WHEN (l_orderkey + l_linenumber) % 41 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS product_id,
  CAST(CASE WHEN (l_orderkey + l_linenumber) % 43 = 0 THEN 0 ELSE l_quantity END AS INTEGER) AS quantity,
  CAST(l_extendedprice AS DOUBLE) / l_quantity AS unit_price, CAST(l_extendedprice AS DOUBLE) AS item_revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""
SQL_TENANT_PRODUCTS = "SELECT p_type AS tenant_id, CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name, CASE WHEN p_partkey % 37 <> 0 THEN p_brand END AS category, CAST(p_retailprice AS DOUBLE) AS base_price FROM part"
