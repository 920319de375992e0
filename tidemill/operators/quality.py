"""Data contracts: ordered rules tag each bad row with the first reason that fits,
duplicates lose to the latest row of their key, and nothing disappears."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.keyed import number_within

REASON = "rejection_reason"
DUPLICATE = "duplicate"


@dataclass(frozen=True)
class Rule:
    reason: str
    broken: Column


def missing(column: str, reason: str) -> Rule:
    return Rule(reason, F.col(column).isNull())


def below(column: str, reason: str, least: float = 0, allow_equal: bool = True) -> Rule:
    """Null, or under the least allowed value (or equal to it, if that is not allowed)."""
    low = F.col(column) < least if allow_equal else F.col(column) <= least
    return Rule(reason, F.col(column).isNull() | low)


@dataclass(frozen=True)
class Contract:
    rules: list[Rule]
    key: list[str]
    latest: list[Column]
    tiebreak: list[Column | str] = field(default_factory=list)

    def tag_rules(self, df: DataFrame) -> DataFrame:
        """df with the reason of the first broken rule, null for a valid row; narrow."""
        reason = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            reason = F.when(rule.broken, F.lit(rule.reason)).otherwise(reason)
        return df.withColumn(REASON, reason)

    def tag(self, df: DataFrame) -> DataFrame:
        """Rule reasons, and `duplicate` for valid rows that are not their key's first.
        Rows that broke a rule skip the shuffle, so null keys cannot gather anywhere."""
        tagged = self.tag_rules(df)
        valid = number_within(tagged.filter(F.col(REASON).isNull()), self.key, self.latest, self.tiebreak, "_rn")
        valid = valid.withColumn(REASON, F.when(F.col("_rn") > 1, F.lit(DUPLICATE))).drop("_rn")
        return valid.unionByName(tagged.filter(F.col(REASON).isNotNull()))

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(valid rows without the reason, rejected rows with it)."""
        tagged = self.tag(df)
        return tagged.filter(F.col(REASON).isNull()).drop(REASON), tagged.filter(F.col(REASON).isNotNull())


def breakdown(tagged: DataFrame) -> DataFrame:
    """Rejected rows by reason."""
    return tagged.filter(F.col(REASON).isNotNull()).groupBy(REASON).agg(F.count("*").alias("n"))


def reconcile(source: DataFrame, tagged: DataFrame) -> DataFrame:
    """One row: rows in, valid, rejected, and whether they add up. The rows in are
    counted from the source itself."""
    counts = tagged.agg(F.count(F.when(F.col(REASON).isNull(), 1)).alias("rows_valid"), F.count(REASON).alias("rows_rejected"))
    return source.agg(F.count("*").alias("rows_in")).crossJoin(counts).withColumn("reconciled", F.col("rows_in") == F.col("rows_valid") + F.col("rows_rejected"))


def orders_contract() -> Contract:
    rules = [missing("tenant_id", "null_tenant"), missing("order_id", "null_order_id"), missing("customer_id", "null_customer"), missing("order_date", "null_date"), below("total_amount", "bad_total")]
    return Contract(rules, ["tenant_id", "order_id"], [F.desc("order_ts")], ["order_date", "total_amount", "customer_id"])


def customers_contract() -> Contract:
    return Contract([missing("tenant_id", "null_tenant"), missing("customer_id", "null_customer_id")], ["tenant_id", "customer_id"], [F.desc("signup_date")], ["name"])


def items_contract() -> Contract:
    rules = [missing("tenant_id", "null_tenant"), missing("order_id", "null_order_id"), missing("order_item_id", "null_item_id"), missing("product_id", "null_product_id"), below("quantity", "bad_quantity", allow_equal=False), below("item_revenue", "bad_revenue")]
    return Contract(rules, ["tenant_id", "order_item_id"], [F.desc("item_revenue")], ["product_id", "quantity"])


def products_contract() -> Contract:
    return Contract([missing("tenant_id", "null_tenant"), missing("product_id", "null_product_id"), missing("category", "null_category")], ["tenant_id", "product_id"], [F.desc("base_price")], ["product_name"])
