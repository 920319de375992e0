"""Measured comparisons of physical choices. Results never differ, only time does."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.joins import merge_join, salted_join
from tidemill.session import scoped_conf


def timed(run: Callable[[], Any]) -> tuple[Any, float]:
    begin = time.perf_counter()
    return run(), time.perf_counter() - begin


def drained_seconds(df: DataFrame) -> float:
    """Seconds to compute all of df, writing it nowhere."""
    return timed(lambda: df.write.format("noop").mode("overwrite").save())[1]


def shuffle_sweep(spark: SparkSession, build: Callable[[], DataFrame], partitions: tuple[int, ...] = (4, 16, 200, 1000)) -> dict[str, float]:
    """Seconds of a query by number of shuffle partitions without adaptive execution,
    and for the largest number with it."""
    out = {}
    for n in partitions:
        with scoped_conf(spark, spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions=str(n)):
            out[f"static_{n}"] = drained_seconds(build())
    with scoped_conf(spark, spark__sql__adaptive__enabled="true", spark__sql__shuffle__partitions=str(max(partitions))):
        out[f"adaptive_{max(partitions)}"] = drained_seconds(build())
    return out


def broadcast_against_merge(spark: SparkSession, facts: DataFrame, dimension: DataFrame, keys: list[str]) -> dict[str, float]:
    with scoped_conf(spark, spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1"):
        merge = drained_seconds(merge_join(facts, dimension, keys))
        return {"merge": merge, "broadcast": drained_seconds(facts.join(F.broadcast(dimension), keys))}


def salted_against_plain(spark: SparkSession, big: DataFrame, small: DataFrame, keys: list[str], salts: int, row_key: list[str]) -> dict[str, float]:
    """Both joins without adaptive execution; raises if their row counts differ."""
    with scoped_conf(spark, spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1"):
        plain, plain_s = timed(lambda: big.join(small, keys).count())
        salted, salted_s = timed(lambda: salted_join(big, small, keys, salts, row_key).count())
    if plain != salted:
        raise AssertionError(f"{salted} rows salted, {plain} plain")
    return {"rows": plain, "plain": plain_s, "salted": salted_s}


def partition_rows(df: DataFrame) -> DataFrame:
    """Rows of each partition of df: how evenly a shuffle has dealt them."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"))


def spill_of(spark: SparkSession, df: DataFrame, partitions: int = 2) -> dict[str, float | None]:
    """Sort df through few partitions and report the bytes spilled, from the status
    store; to force spills the session needs
    spark.shuffle.spill.numElementsForceSpillThreshold at its start."""
    with scoped_conf(spark, spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions=str(partitions)):
        seconds = drained_seconds(df)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    memory = sum(stages.apply(k).memoryBytesSpilled() for k in range(stages.size()))
    disk = sum(stages.apply(k).diskBytesSpilled() for k in range(stages.size()))
    return {"seconds": seconds, "memory_bytes": memory, "disk_bytes": disk}
