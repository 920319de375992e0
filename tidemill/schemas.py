"""Explicit schemas and the grain of every table. Not-null is a contract that
`quality` enforces, since files always read back as nullable."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()  # noqa: E741
TENANTS = _schema(tenant_id=S, tenant_name=S, tier=S, signup_date=S)
CUSTOMERS = _schema(tenant_id=S, customer_id=S, name=S, email=S, country=S, signup_date=T.DateType())
PRODUCTS = _schema(tenant_id=S, product_id=S, product_name=S, category=S, base_price=D)
ORDERS = _schema(tenant_id=S, order_id=S, customer_id=S, order_ts=T.TimestampType(), order_date=T.DateType(), status=S, currency=S, subtotal=D, tax=D, shipping=D, total_amount=D, payment_status=S)
ORDER_ITEMS = _schema(tenant_id=S, order_id=S, order_item_id=S, product_id=S, quantity=I, unit_price=D, item_revenue=D)
CLICKS = _schema(tenant_id=S, event_id=S, session_id=S, customer_id=S, event_ts=T.TimestampType(), event_date=S, event_type=S, product_id=S, page_url=S, device_type=S)
CHANGES = _schema(op=S, commit_ts=T.TimestampType(), seq=L, tenant_id=S, order_id=S, status=S, total_amount=D)

# every key is composite: an id is only unique within its tenant
KEYS = {
    "tenants": ["tenant_id"],
    "customers": ["tenant_id", "customer_id"],
    "products": ["tenant_id", "product_id"],
    "orders": ["tenant_id", "order_id"],
    "order_items": ["tenant_id", "order_item_id"],
    "clicks": ["event_id"],
    "changes": ["tenant_id", "order_id", "commit_ts", "seq"],
}
SCHEMAS = {"tenants": TENANTS, "customers": CUSTOMERS, "products": PRODUCTS, "orders": ORDERS, "order_items": ORDER_ITEMS, "clicks": CLICKS, "changes": CHANGES}
