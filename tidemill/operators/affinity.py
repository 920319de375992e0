"""What is bought together, and how many pairs that will be before they are made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class PairExplosion(RuntimeError):
    """The self-join would make more pairs than allowed."""


def basket_sizes(items: DataFrame, basket: list[str], item: str | None = None) -> DataFrame:
    """k items by basket: rows, or distinct values of `item`."""
    rows = items if item is None else items.select(*basket, item).distinct()
    return rows.groupBy(*basket).agg(F.count("*").alias("k"))


def predict_pairs(sizes: DataFrame, cap: int | None = None) -> DataFrame:
    """Baskets, their smallest, mean and largest size, and the sum of k(k-1)/2. With a
    cap, only baskets up to that size count."""
    rows = sizes if cap is None else sizes.filter(F.col("k") <= cap)
    return rows.agg(F.count("*").alias("baskets"), F.min("k").alias("min_k"), F.avg("k").alias("avg_k"), F.max("k").alias("max_k"), F.coalesce(F.sum(F.col("k") * (F.col("k") - 1) / 2), F.lit(0.0)).alias("pairs"))


def affinity(items: DataFrame, basket: list[str], item: str, group: list[str], least: int = 2, cap: int | None = None, max_ratio: float = 64.0) -> DataFrame:
    """Unordered pairs of distinct items that share at least `least` baskets.

    cap leaves out larger baskets; a self-join that would make over max_ratio pairs for
    each basket item is refused before it starts.
    """
    keys = list(dict.fromkeys([*group, *basket]))
    distinct = items.select(*keys, item).distinct()
    if cap is not None:
        kept = basket_sizes(items, keys, item).filter(F.col("k") <= cap).select(*keys)
        distinct = distinct.join(kept, keys, "left_semi")
    found = predict_pairs(basket_sizes(items, keys, item), cap).first()
    allowed = max_ratio * found["baskets"] * (found["avg_k"] or 0)
    if found["pairs"] > allowed:
        raise PairExplosion(f"{found['pairs']:.0f} pairs predicted, {allowed:.0f} allowed")
    a, b = distinct.withColumnRenamed(item, "item_a"), distinct.withColumnRenamed(item, "item_b")
    pairs = a.join(b, keys).filter(F.col("item_a") < F.col("item_b"))
    return pairs.groupBy(*group, "item_a", "item_b").agg(F.count("*").alias("co_occurrences")).filter(F.col("co_occurrences") >= least)
