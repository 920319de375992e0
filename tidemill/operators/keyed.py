"""Row selection within keys. Every ordering ends in a tiebreak, so results do not
depend on how rows were partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(key: list[str], order: list[Column], tiebreak: list[Column | str]):
    if not tiebreak:
        raise ValueError("an ordering needs a tiebreak")
    return Window.partitionBy(*key).orderBy(*order, *tiebreak)


def number_within(df: DataFrame, key: list[str], order: list[Column], tiebreak: list[Column | str], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(_ordered(key, order, tiebreak)))


def latest_per_key(df: DataFrame, key: list[str], order: list[Column], tiebreak: list[Column | str]) -> DataFrame:
    """The first row of each key. Only rank 1 is asked for, so each map task sends at
    most one row per key."""
    return number_within(df, key, order, tiebreak, "_rn").filter("_rn = 1").drop("_rn")


def top_n(df: DataFrame, key: list[str], order: list[Column], tiebreak: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each key, numbered in row_number."""
    return number_within(df, key, order, tiebreak, "row_number").filter(F.col("row_number") <= n)


def with_ranks(df: DataFrame, key: list[str], order: list[Column], tiebreak: list[Column | str]) -> DataFrame:
    """row_number (by order and tiebreak), rank and dense_rank (by order alone)."""
    ties = Window.partitionBy(*key).orderBy(*order)
    return number_within(df, key, order, tiebreak, "row_number").withColumn("rank", F.rank().over(ties)).withColumn("dense_rank", F.dense_rank().over(ties))


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows overall; order must be total for a stable result."""
    return df.orderBy(*order).limit(k)


def arg_max(df: DataFrame, group: str, name: str = "n") -> DataFrame:
    """The value of `group` with most rows (the smallest one on a tie) and its count."""
    return top_k(df.groupBy(group).agg(F.count("*").alias(name)), [F.desc(name), F.asc(group)], 1)
