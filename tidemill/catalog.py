"""Every named query of the library and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill import bindings as B
from tidemill.functions.exprs import any_if, exact_sum, max_if, sum_if
from tidemill.functions.exprs import minute_label as hour_and_minute
from tidemill.operators import affinity, changes, checks, features, joins, keyed, marts, quality
from tidemill.plans.inspect import plan_facts
from tidemill.plans.layout import layout_of
from tidemill.schemas import SCHEMAS
from tidemill.session import scratch
from tidemill.sources import tables
from tidemill.streaming import clicks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
KEY = ("order_id",)


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that returns the same."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# sources, sinks and simple predicates


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def bronze_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as CSV, read with an explicit schema and kept as Parquet."""
    rows = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("o_orderdate"))
    landing = scratch(spark, "landing")
    tables.write_csv(rows, landing)
    return tables.write_table(tables.read_csv(spark, landing, rows.schema), scratch(spark, "bronze"))


def _landed(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """Rows laid down as CSV and taken in with the table's schema."""
    schema, landing = SCHEMAS[name], scratch(spark, f"landing-{name}")
    tables.write_csv(rows.select([F.col(f.name).cast(f.dataType) for f in schema]), landing)
    return tables.ingest_csv(spark, landing, schema, scratch(spark, f"bronze-{name}"))


@query("SELECT c_mktsegment AS tenant_id, CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS name, concat('c', c_custkey, '@example.com') AS email, CAST(c_nationkey AS VARCHAR) AS country, DATE '1995-01-01' AS signup_date FROM customer")
def bronze_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    rows = B.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("tenant_id"), key.alias("customer_id"), F.col("c_name").alias("name"), F.concat(F.lit("c"), key, F.lit("@example.com")).alias("email"), F.col("c_nationkey").alias("country"), F.lit("1995-01-01").cast("date").alias("signup_date"))
    return _landed(spark, rows, "customers")


@query(f"SELECT tenant_id, product_id, product_name, category, base_price FROM ({B.SQL_TENANT_PRODUCTS})")
def bronze_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landed(spark, B.tenant_products(spark, sf_dir), "products")


@query(f"SELECT * FROM ({B.SQL_TENANT_ITEMS})")
def bronze_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landed(spark, B.tenant_items(spark, sf_dir), "order_items")


@query("SELECT count(*) AS n FROM orders WHERE o_orderkey % 2 = 0")
def count_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.03 AND l_returnflag = 'R'")
def filter_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "lineitem").filter((F.col("l_quantity") >= 45) & (F.col("l_discount") < 0.03)).filter(F.col("l_returnflag") == "R").select("l_orderkey", "l_extendedprice")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date FROM orders WHERE CAST(o_orderdate AS DATE) IN (DATE '1996-01-02', DATE '1997-05-06', DATE '1999-12-31')")
def isin_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = [F.lit(d).cast("date") for d in ("1996-01-02", "1997-05-06", "1999-12-31")]
    return B.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("order_date")).filter(F.col("order_date").isin(days))


# contracts

_ORDER_COLUMNS = "tenant_id, order_id, customer_id, order_ts, order_date, status, total_amount"


@query(f"WITH {B.SQL_DIRTY} SELECT order_id, total_amount, reason AS rejection_reason FROM tagged")
def rule_tag_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.orders_contract().tag_rules(B.dirty_orders(spark, sf_dir)).select("order_id", "total_amount", "rejection_reason")


@query(f"WITH {B.SQL_DIRTY} SELECT tenant_id, order_id, customer_id, order_date, status, total_amount FROM judged WHERE rejection_reason IS NULL")
def silver_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.orders_contract().split(B.dirty_orders(spark, sf_dir))[0].select("tenant_id", "order_id", "customer_id", "order_date", "status", "total_amount")


@query("SELECT c_mktsegment AS tenant_id, c_custkey AS customer_id, c_name AS name FROM customer WHERE c_mktsegment IS NOT NULL AND c_custkey IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c_mktsegment, c_custkey ORDER BY c_name) = 1")
def silver_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.customers_contract().split(B.customers(spark, sf_dir))[0].select("tenant_id", "customer_id", "name")


_ITEM_ORDER = "l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice"


@query(f"""SELECT tenant_id, order_id, order_item_id, product_id, quantity, item_revenue FROM ({B.SQL_TENANT_ITEMS}) WHERE tenant_id IS NOT NULL AND product_id IS NOT NULL AND quantity > 0 AND item_revenue >= 0
QUALIFY row_number() OVER (PARTITION BY tenant_id, order_item_id ORDER BY item_revenue DESC, product_id, quantity) = 1""")
def silver_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.items_contract().split(B.tenant_items(spark, sf_dir))[0].select("tenant_id", "order_id", "order_item_id", "product_id", "quantity", "item_revenue")


@query(f"SELECT * FROM ({B.SQL_TENANT_PRODUCTS}) WHERE tenant_id IS NOT NULL AND category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tenant_id, product_id ORDER BY base_price DESC, product_name) = 1")
def silver_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.products_contract().split(B.tenant_products(spark, sf_dir))[0]


@query(f"WITH {B.SQL_DIRTY} SELECT order_id, customer_id, order_date, total_amount, rejection_reason FROM judged WHERE rejection_reason IS NOT NULL")
def rejected_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.orders_contract().split(B.dirty_orders(spark, sf_dir))[1].select("order_id", "customer_id", "order_date", "total_amount", "rejection_reason")


@query(f"WITH {B.SQL_DIRTY} SELECT rejection_reason, count(*) AS n FROM judged WHERE rejection_reason IS NOT NULL GROUP BY rejection_reason ORDER BY n DESC, rejection_reason")
def reject_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.breakdown(quality.orders_contract().tag(B.dirty_orders(spark, sf_dir))).orderBy(F.desc("n"), "rejection_reason")


@query(f"""WITH {B.SQL_DIRTY} SELECT (SELECT count(*) FROM dirty) AS rows_in, count(*) FILTER (rejection_reason IS NULL) AS rows_valid, count(rejection_reason) AS rows_rejected,
(SELECT count(*) FROM dirty) = count(*) AS reconciled FROM judged""")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = B.dirty_orders(spark, sf_dir)
    return quality.reconcile(dirty, quality.orders_contract().tag(dirty))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ITEM_ORDER}) = 1")
def dedupe_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.latest_per_key(B.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], [F.desc("l_shipdate")], ["l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


# joins


@query(f"WITH {B.SQL_ORDERS} SELECT o.tenant_id, o.order_id, c.c_name AS name, o.total_amount FROM orders_t o JOIN customer c ON o.tenant_id = c.c_mktsegment AND o.customer_id = c.c_custkey")
def join_composite_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.keyed_join(B.orders(spark, sf_dir), B.customers(spark, sf_dir), ["tenant_id", "customer_id"]).select("tenant_id", "order_id", "name", "total_amount")


@query("""WITH f AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(*) AS orders FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT c_custkey AS customer_id, revenue, orders FROM customer LEFT JOIN f ON c_custkey = o_custkey""")
def join_left_preserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = B.plain_orders(spark, sf_dir).filter(F.col("status") == B.STATUS).groupBy("customer_id").agg(exact_sum("total_amount").alias("revenue"), F.count("*").alias("orders"))
    return B.customers(spark, sf_dir).select("customer_id").join(totals, "customer_id", "left")


@query("SELECT l_orderkey AS order_id, l_linenumber AS line, p_brand AS category, l_extendedprice AS item_revenue FROM lineitem JOIN part ON l_partkey = p_partkey")
def join_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.enrich(B.items(spark, sf_dir), B.products(spark, sf_dir), ["product_id"], "inner").select("order_id", "line", "category", "item_revenue")


@query("SELECT l_orderkey AS order_id, l_linenumber AS line, o_orderstatus AS status, l_extendedprice AS item_revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_sort_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.merge_join(B.items(spark, sf_dir), B.plain_orders(spark, sf_dir), ["order_id"]).select("order_id", "line", "status", "item_revenue")


@query("""WITH o(tenant_id, customer_id, total) AS (VALUES ('A', 1, 100.0), ('B', 1, 999.0)), c(tenant_id, customer_id, name) AS (VALUES ('A', 1, 'Alice'), ('B', 1, 'Bob'))
SELECT (SELECT count(*) FROM o JOIN c ON o.customer_id = c.customer_id) AS under_keyed_rows, (SELECT count(*) FROM o JOIN c ON o.customer_id = c.customer_id AND o.tenant_id = c.tenant_id) AS composite_rows""")
def join_trap_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.inline(spark, [("A", 1, 100.0), ("B", 1, 999.0)], "tenant_id string, customer_id int, total double")
    people = tables.inline(spark, [("A", 1, "Alice"), ("B", 1, "Bob")], "tenant_id string, customer_id int, name string")
    wrong = joins.keyed_join(orders, people, ["customer_id"], required=()).agg(F.count("*").alias("under_keyed_rows"))
    return wrong.crossJoin(joins.keyed_join(orders, people, ["tenant_id", "customer_id"]).agg(F.count("*").alias("composite_rows")))


@query("SELECT r_regionkey, r_name, CAST(s.range AS BIGINT) AS salt FROM region CROSS JOIN range(3) s")
def cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "region").select("r_regionkey", "r_name").crossJoin(spark.range(3).withColumnRenamed("id", "salt"))


@query("SELECT l_orderkey AS order_id, l_linenumber AS line, l_extendedprice AS item_revenue FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')")
def anti_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = B.plain_orders(spark, sf_dir).filter(F.col("status") != "P")
    return joins.orphans(B.items(spark, sf_dir), parents, ["order_id"]).select("order_id", "line", "item_revenue")


_HOT = "CASE WHEN o_orderkey % 10 < 6 THEN 'hot' ELSE concat('k', o_custkey % 20) END"


def _hot_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_HOT).alias("skew_key"))


@query(f"""WITH big AS (SELECT o_orderkey, {_HOT} AS skew_key FROM orders), keys AS (SELECT DISTINCT skew_key FROM big)
SELECT big.o_orderkey, big.skew_key, f.range AS copy FROM big JOIN keys USING (skew_key) CROSS JOIN range(3) f""")
def salted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = _hot_orders(spark, sf_dir)
    small = big.select("skew_key").distinct().crossJoin(spark.range(3).withColumnRenamed("id", "copy"))
    return joins.salted_join(big, small, ["skew_key"], 16, ["o_orderkey"], hot_share=0.05).select("o_orderkey", "skew_key", "copy")


@query(f"SELECT {_HOT} AS skew_key, count(*) AS n, count(*) / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY 1")
def skew_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.skew_profile(_hot_orders(spark, sf_dir), F.col("skew_key"))


@query("""SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS left_keys, (SELECT count(DISTINCT c_custkey) FROM customer) AS right_keys,
(SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)) AS shared_keys""")
def key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.key_overlap(B.plain_orders(spark, sf_dir).select("customer_id"), B.customers(spark, sf_dir).select("customer_id"), ["customer_id"])


# marts and aggregation


@query(f"WITH {B.SQL_ORDERS} SELECT tenant_id, CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders_t WHERE status = 'F' GROUP BY tenant_id")
def revenue_by_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.revenue_by_tenant(B.orders(spark, sf_dir), B.STATUS)


@query(f"WITH {B.SQL_MART} SELECT * FROM mart")
def daily_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.daily_revenue(B.items(spark, sf_dir), B.orders(spark, sf_dir), B.products(spark, sf_dir), B.STATUS, KEY, ("product_id",))


@query(f"WITH {B.SQL_MART} SELECT * FROM mart WHERE order_date BETWEEN DATE '1998-03-01' AND DATE '1998-03-10'")
def daily_revenue_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping rebuilds of a partitioned mart, read back."""
    path, args = scratch(spark, "mart"), (B.items(spark, sf_dir), B.orders(spark, sf_dir), B.products(spark, sf_dir))
    keys = {"status": B.STATUS, "order_key": KEY, "product_key": ("product_id",)}
    marts.rebuild_daily_revenue(*args, path, "1998-03-01", "1998-03-07", **keys)
    return marts.rebuild_daily_revenue(*args, path, "1998-03-05", "1998-03-10", **keys)


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_partkey").alias("parts"))


@query("""SELECT o_custkey AS customer_id, CAST(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS complete_revenue,
max(CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderdate AS DATE) END) AS last_open, CAST(max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS INT) AS has_pending FROM orders GROUP BY o_custkey""")
def conditional_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("status")
    return B.plain_orders(spark, sf_dir).groupBy("customer_id").agg(sum_if(status == "F", "total_amount").alias("complete_revenue"), max_if(status == "O", "order_date").alias("last_open"), any_if(status == "P").alias("has_pending"))


@query("SELECT p_brand AS category, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(*) >= (SELECT count(*) / 25 FROM lineitem)")
def having_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = joins.enrich(B.items(spark, sf_dir), B.products(spark, sf_dir), ["product_id"], "inner").groupBy("category").agg(F.count("*").alias("n"))
    least = B.items(spark, sf_dir).agg((F.count("*") / 25).alias("least"))
    return counts.crossJoin(F.broadcast(least)).filter(F.col("n") >= F.col("least")).select("category", "n")


@query(f"WITH {B.SQL_MART} SELECT * FROM mart ORDER BY revenue DESC, tenant_id, order_date, category LIMIT 20")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the 20 largest cells of the mart."""
    return keyed.top_k(daily_revenue(spark, sf_dir), [F.desc("revenue"), F.asc("tenant_id"), F.asc("order_date"), F.asc("category")], 20)


@query("SELECT CAST(o_orderdate AS DATE) AS order_date, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, order_date LIMIT 1")
def argmax_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.arg_max(B.plain_orders(spark, sf_dir), "order_date")


@query("""WITH r AS (SELECT p_brand AS category, p_partkey AS product_id, p_name AS product_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY revenue DESC, product_id) AS INT) AS row_number, CAST(rank() OVER (PARTITION BY category ORDER BY revenue DESC) AS INT) AS rank,
CAST(dense_rank() OVER (PARTITION BY category ORDER BY revenue DESC) AS INT) AS dense_rank FROM r QUALIFY row_number() OVER (PARTITION BY category ORDER BY revenue DESC, product_id) <= 5""")
def top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.top_products(B.items(spark, sf_dir), B.products(spark, sf_dir), 5, ("category",), ("product_id",))


@query("""SELECT p_brand, p_partkey, p_size, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS INT) AS row_number,
CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS INT) AS rank, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS INT) AS dense_rank FROM part""")
def rank_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.with_ranks(B.table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], [F.desc("p_size")], ["p_partkey"])


# features


@query(f"""WITH {B.SQL_ORDERS}, f AS (SELECT tenant_id, customer_id, CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS lifetime_revenue, count(*) AS lifetime_orders,
min(order_date) AS first_order_date, max(order_date) AS last_order_date FROM orders_t WHERE status = 'F' GROUP BY ALL)
SELECT *, lifetime_revenue / lifetime_orders AS avg_order_value, CAST(date_diff('day', last_order_date, DATE '{B.AS_OF}') AS INT) AS days_since_last_order, DATE '{B.AS_OF}' AS as_of_date FROM f""")
def ltv_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.lifetime_features(B.orders(spark, sf_dir), B.AS_OF, B.STATUS)


_PIT = f"""WITH {B.SQL_ORDERS}, m AS (SELECT tenant_id, customer_id,
CAST(coalesce(sum(CASE WHEN order_date >= DATE '{B.AS_OF}' - 7 THEN CAST(total_amount AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS revenue_7d, count(CASE WHEN order_date >= DATE '{B.AS_OF}' - 7 THEN 1 END) AS orders_7d,
CAST(coalesce(sum(CASE WHEN order_date >= DATE '{B.AS_OF}' - 30 THEN CAST(total_amount AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS revenue_30d, count(CASE WHEN order_date >= DATE '{B.AS_OF}' - 30 THEN 1 END) AS orders_30d,
CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS lifetime_revenue, count(*) AS lifetime_orders, CAST(date_diff('day', max(order_date), DATE '{B.AS_OF}') AS INT) AS days_since_last_order
FROM orders_t WHERE status = 'F' AND order_date <= DATE '{B.AS_OF}' GROUP BY ALL),
pit AS (SELECT c_mktsegment AS tenant_id, c_custkey AS customer_id, coalesce(revenue_7d, 0) AS revenue_7d, coalesce(orders_7d, 0) AS orders_7d, coalesce(revenue_30d, 0) AS revenue_30d, coalesce(orders_30d, 0) AS orders_30d,
coalesce(lifetime_revenue, 0) AS lifetime_revenue, coalesce(lifetime_orders, 0) AS lifetime_orders, days_since_last_order, DATE '{B.AS_OF}' AS as_of_date
FROM customer LEFT JOIN m ON c_mktsegment = tenant_id AND c_custkey = customer_id)"""


@query(f"{_PIT} SELECT * FROM pit")
def pit_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.point_in_time_features(B.customers(spark, sf_dir), B.orders(spark, sf_dir), B.AS_OF, status=B.STATUS)


@query("SELECT c_custkey AS customer_id, coalesce(n, 0) AS orders, CAST(coalesce(revenue, 0) AS DOUBLE) AS revenue, last_order FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, max(CAST(o_orderdate AS DATE)) AS last_order FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY o_custkey) ON c_custkey = o_custkey")
def na_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = B.plain_orders(spark, sf_dir).filter((F.col("status") == B.STATUS) & (F.col("order_date") < F.lit("1996-01-01").cast("date")))
    totals = early.groupBy("customer_id").agg(F.count("*").alias("orders"), exact_sum("total_amount").alias("revenue"), F.max("order_date").alias("last_order"))
    return joins.fill_from(B.customers(spark, sf_dir).select("customer_id"), totals, ["customer_id"], ["orders", "revenue"])


_LEAK = f"""WITH {B.SQL_ORDERS}, g AS (SELECT tenant_id, customer_id, max(CASE WHEN order_date <= DATE '{B.AS_OF}' THEN order_date END) AS known, max(order_date) AS leaked,
max(CASE WHEN order_date > DATE '{B.AS_OF}' AND order_date <= DATE '{B.AS_OF}' + 30 THEN 1 ELSE 0 END) AS label FROM orders_t WHERE status = 'F' GROUP BY ALL),
l AS (SELECT date_diff('day', known, DATE '{B.AS_OF}') AS recency, date_diff('day', leaked, DATE '{B.AS_OF}') AS leaky_recency, CAST(label AS INT) AS label FROM g WHERE known IS NOT NULL)"""


@query(f"{_LEAK} SELECT label, round(avg(recency), 1) AS mean_recency, round(avg(leaky_recency), 1) AS mean_leaky_recency, count(*) AS customers FROM l GROUP BY label")
def leakage_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.leakage_by_label(features.leakage_rows(B.orders(spark, sf_dir), B.AS_OF, status=B.STATUS))


@query(f"{_LEAK} SELECT count(*) AS customers, count(*) FILTER (leaky_recency < 0) AS negative_leaky, count(*) FILTER (recency < 0) AS negative_known, count(*) FILTER (leaky_recency < 0) / count(*) AS negative_share FROM l")
def leakage_negative_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.leakage_share(features.leakage_rows(B.orders(spark, sf_dir), B.AS_OF, status=B.STATUS))


# affinity


def _branded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.enrich(B.items(spark, sf_dir).select("order_id", "product_id"), B.products(spark, sf_dir).select("product_id", "category"), ["product_id"], "inner")


@query("""WITH d AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT a.p_brand AS item_a, b.p_brand AS item_b, count(*) AS co_occurrences FROM d a JOIN d b ON a.l_orderkey = b.l_orderkey AND a.p_brand < b.p_brand GROUP BY ALL HAVING count(*) >= 2""")
def affinity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return affinity.affinity(_branded(spark, sf_dir), ["order_id"], "category", [])


_SIZES = "WITH s AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS k FROM lineitem GROUP BY l_orderkey)"
_PREDICT = "SELECT count(*) AS baskets, min(k) AS min_k, avg(k) AS avg_k, max(k) AS max_k, CAST(coalesce(sum(k * (k - 1) / 2.0), 0) AS DOUBLE) AS pairs FROM s"


@query(f"{_SIZES} {_PREDICT}")
def explosion_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return affinity.predict_pairs(affinity.basket_sizes(B.items(spark, sf_dir), ["order_id"], "product_id"))


@query(f"{_SIZES} {_PREDICT} WHERE k <= 6")
def basket_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return affinity.predict_pairs(affinity.basket_sizes(B.items(spark, sf_dir), ["order_id"], "product_id"), 6)


# change log


def _change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log of all orders, written as JSON lines and read with its schema."""
    from tidemill.schemas import CHANGES
    from tidemill.sources.generate import change_log

    rows = B.table(spark, sf_dir, "orders").select(F.lit("t").alias("tenant_id"), F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_totalprice").alias("total_amount"), F.col("o_orderkey").alias("n"))
    path = scratch(spark, "changes")
    change_log(rows).write.json(path)
    return tables.read_json(spark, path, CHANGES)


_STATE = """WITH log AS (
  SELECT 'I' AS op, 0 AS m, o_orderkey AS k, 'PENDING' AS status, o_totalprice AS total_amount FROM orders
  UNION ALL SELECT 'U', 5, o_orderkey, 'COMPLETE', o_totalprice FROM orders WHERE o_orderkey % 10 < 6
  UNION ALL SELECT 'U', 10, o_orderkey, 'RETURNED', o_totalprice FROM orders WHERE o_orderkey % 10 = 0
  UNION ALL SELECT 'D', 15, o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 25 < 2),
last AS (SELECT * FROM log WHERE m <= {minutes} QUALIFY row_number() OVER (PARTITION BY k ORDER BY m DESC) = 1)
SELECT CAST(k AS VARCHAR) AS order_id, strftime(TIMESTAMP '2026-07-04 00:00:00' + to_minutes(m), '%H:%M') AS committed, status, total_amount FROM last WHERE op <> 'D'"""


def _shown(state: DataFrame) -> DataFrame:
    return state.select("order_id", F.date_format("commit_ts", "HH:mm").alias("committed"), "status", "total_amount")


@query(_STATE.format(minutes=99))
def cdc_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(changes.current_state(_change_log(spark, sf_dir), ["tenant_id", "order_id"]))


@query(_STATE.format(minutes=7))
def cdc_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(changes.current_state(_change_log(spark, sf_dir), ["tenant_id", "order_id"], as_of="2026-07-04 00:07:00"))


# streaming


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, drained in complete mode into a table."""
    schema = B.table(spark, sf_dir, "events").schema
    events = tables.stream_parquet(spark, sf_dir, "events.parquet", schema)
    counts = clicks.windowed_counts(events, "ts", width="1 hour", late="2 minutes")
    path = scratch(spark, "windows")
    clicks.drain(counts, path, scratch(spark, "offsets"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    return clicks.drained(spark, path, counts).select(shown("window_start"), shown("window_end"), "event_type", "n")


@query("SELECT strftime(ts, '%H:%M') AS minute, event_type, count(*) AS n FROM events GROUP BY ALL")
def minute_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "events").groupBy(hour_and_minute("ts").alias("minute"), "event_type").agg(F.count("*").alias("n"))


# checks, plans and ad-hoc SQL


@query("""SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS mart_sum, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS source_sum, true AS agrees
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""")
def mart_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    complete = B.plain_orders(spark, sf_dir).filter(F.col("status") == B.STATUS).select("order_id")
    return checks.sums_agree(daily_revenue(spark, sf_dir), B.items(spark, sf_dir).join(complete, "order_id"), "revenue", "item_revenue")


@query(f"{_PIT} SELECT count(*) FILTER (revenue_7d > revenue_30d + 0.001) AS revenue_7d_over_revenue_30d, count(*) FILTER (revenue_30d > lifetime_revenue + 0.001) AS revenue_30d_over_lifetime_revenue FROM pit")
def feature_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.window_order(pit_features(spark, sf_dir), ["revenue_7d", "revenue_30d", "lifetime_revenue"])


@query("SELECT count(*) FILTER (l_orderkey IS NULL) AS null_order, count(*) FILTER (l_extendedprice < 0) AS negative_revenue, count(*) FILTER (l_quantity <= 0) AS bad_quantity FROM lineitem")
def contract_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.violations(B.table(spark, sf_dir, "lineitem"), {"null_order": F.col("l_orderkey").isNull(), "negative_revenue": F.col("l_extendedprice") < 0, "bad_quantity": F.col("l_quantity") <= 0})


@query("SELECT r_name, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1 ORDER BY r DESC")
def sql_view_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register_views({name: tables.read_optional(spark, f"{sf_dir}/{name}.parquet") for name in ("customer", "nation", "region")})
    return spark.sql("SELECT r_name, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1 ORDER BY r DESC")


@query("SELECT 'l_quantity' AS pushed, 2 AS columns_read, 0 AS exchanges")
def plan_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a filtered projection reads, from its physical plan."""
    facts = plan_facts(B.table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") >= 45).select("l_quantity", "l_orderkey"))
    pushed = "l_quantity" if "GreaterThanOrEqual(l_quantity" in " ".join(facts.pushed) else "nothing"
    return tables.inline(spark, [(pushed, len(facts.read_columns[0]), facts.exchanges)], "pushed string, columns_read int, exchanges int")


@query("SELECT count(DISTINCT event_type) AS folders, count(DISTINCT event_type) AS files, count(*) AS n FROM events")
def layout_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tidy partitioned table: one folder and one file for each value."""
    path = scratch(spark, "tidy")
    written = tables.write_table(B.table(spark, sf_dir, "events"), path, ["event_type"], tidy=True)
    found = layout_of(spark, path)
    return written.agg(F.lit(found.folders).cast("long").alias("folders"), F.lit(found.files).cast("long").alias("files"), F.count("*").alias("n"))


@query("SELECT count(DISTINCT s_suppkey) AS folders, count(DISTINCT s_suppkey) AS files, count(*) AS n FROM supplier")
def layout_high_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout to avoid: a key as partition column gives a folder and a tiny file for each value."""
    path = scratch(spark, "high-cardinality")
    written = tables.write_table(B.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), path, ["s_suppkey"], tidy=True)
    found = layout_of(spark, path)
    return written.agg(F.lit(found.folders).cast("long").alias("folders"), F.lit(found.files).cast("long").alias("files"), F.count("*").alias("n"))


@query("SELECT count(*) AS meant, count(*) AS found, true AS same_columns FROM orders")
def verify_after_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = scratch(spark, "verified"), B.plain_orders(spark, sf_dir)
    tables.write_table(rows, path)
    return tables.inline(spark, [tables.verify_written(rows, path)], "meant long, found long, same_columns boolean")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def limit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(10)


@query("SELECT true AS refused, count(*) AS n FROM nation")
def static_overwrite_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that would overwrite its own input is refused, and the input survives."""
    path = scratch(spark, "guarded")
    kept = tables.write_table(B.table(spark, sf_dir, "nation"), path)
    try:
        tables.write_table(kept.filter("n_nationkey > 5"), path)
        refused = False
    except tables.SelfOverwrite:
        refused = True
    return kept.agg(F.lit(refused).alias("refused"), F.count("*").alias("n"))


# set operations


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "orders")
    return rows.filter("o_orderstatus = 'F'").select("o_custkey").subtract(rows.filter("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT * FROM (SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region)")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return nations.unionByName(B.table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("id")))
