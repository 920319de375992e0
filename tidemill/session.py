"""Sessions, scoped settings and scratch space."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "tidemill", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and the given settings. The master is set
    only on request, so the function works under spark-submit as well."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextlib.contextmanager
def scoped_conf(spark: SparkSession, **conf: str | None) -> Iterator[None]:
    """Set session settings (`spark__sql__...` for dots; None unsets) and restore them."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextlib.contextmanager
def job_description(spark: SparkSession, text: str) -> Iterator[None]:
    """Label the jobs of a block in the UI and the event log."""
    spark.sparkContext.setJobDescription(text)
    try:
        yield
    finally:
        spark.sparkContext.setJobDescription(None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the space that all executors share, spark.checkpoint.dir.
    Where the session names none, a temporary folder is made, on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/tidemill/{name}-{uuid.uuid4().hex}"


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of df."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """df with a broadcast hint if its estimated size is under the limit; otherwise df,
    and the join is left to adaptive execution."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df
