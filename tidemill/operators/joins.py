"""Joins that keep their promises: composite keys, left rows preserved, checked
broadcasts, orphans, and salting for a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.session import broadcast_if_small


class UnderKeyed(ValueError):
    """A join leaves out a column that its tables need for a key."""


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", required: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    """Equi-join; refuses keys without a required column that both sides have."""
    lacking = [c for c in required if c not in keys and c in left.columns and c in right.columns]
    if lacking:
        raise UnderKeyed(f"join keys {keys} leave out {lacking}")
    return left.join(right, keys, how)


def enrich(facts: DataFrame, dimension: DataFrame, keys: list[str], how: str = "left", limit: int = 64 << 20) -> DataFrame:
    """Join a dimension, broadcast only if its estimated size is under the limit."""
    return facts.join(broadcast_if_small(dimension, limit), keys, how)


def merge_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A sort-merge join by hint, without touching session settings."""
    return left.hint("merge").join(right.hint("merge"), keys, how)


def preserves_left(left: DataFrame, joined: DataFrame) -> bool:
    """Whether a left join has as many rows as its left side."""
    return left.count() == joined.count()


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of child without a parent; null keys count as orphans."""
    return child.join(parent.select(*keys), keys, "left_anti")


def fill_from(dimension: DataFrame, measures: DataFrame, keys: list[str], zero: list[str]) -> DataFrame:
    """Every dimension row with its measures; the named ones are 0 where there are none."""
    return dimension.join(measures, keys, "left").na.fill(0, zero)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salts: int, row_key: list[str], hot_share: float | None = None) -> DataFrame:
    """Inner join with the big side's keys spread over `salts` and the small side
    repeated for each of them. The salt is a hash of row_key, so a task that runs
    again deals the same rows the same way.

    With hot_share, only keys that hold more than this share of the big side's rows (at
    most 1 / hot_share of them, so they can be broadcast) are spread and repeated.
    """
    salt, repeats = F.pmod(F.xxhash64(*row_key), F.lit(salts)).cast("int"), F.sequence(F.lit(0), F.lit(salts - 1))
    if hot_share is not None:
        counts = big.groupBy(*keys).agg(F.count("*").alias("_n"))
        total = counts.agg(F.sum("_n").alias("_total"))
        hot = counts.crossJoin(F.broadcast(total)).filter(F.col("_n") > F.col("_total") * hot_share).select(*keys, F.lit(True).alias("_hot"))
        big, small = (x.join(F.broadcast(hot), keys, "left") for x in (big, small))
        salt, repeats = F.when(F.col("_hot"), salt).otherwise(0), F.when(F.col("_hot"), repeats).otherwise(F.array(F.lit(0)))
    spread = big.withColumn("_salt", salt).drop("_hot")
    copies = small.withColumn("_salt", F.explode(repeats)).drop("_hot")
    return spread.join(copies, [*keys, "_salt"]).drop("_salt")


def skew_profile(df: DataFrame, key: Column, name: str = "skew_key") -> DataFrame:
    """Rows and share of all rows by key, counted in one pass."""
    counts = df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(name, "n", (F.col("n") / F.col("_total")).alias("share"))


def key_overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: distinct keys on the left, on the right, and on both sides."""
    sides = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    by_key = sides.groupBy(*keys).agg(F.max("_l").alias("l"), F.max("_r").alias("r"))
    return by_key.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("left_keys"), F.coalesce(F.sum("r"), F.lit(0)).alias("right_keys"), F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("shared_keys"))
