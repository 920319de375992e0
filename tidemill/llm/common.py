"""Shared plumbing of the training-data operators: where intermediate tables go,
how workers find this package, and joins that survive a hot key."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_libc = ctypes.CDLL(None)
#: Rows and bytes of a batch, where the session says nothing else.
BATCH_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}
ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package whatever directory the driver started in,
    and keep the batches that they get small, unless the session has its own sizes:
    texts can be long, and the JVM holds each batch outside its heap."""
    for key, size in BATCH_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, size)
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in have.split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{have}" if have else ROOT
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Where the
    session names none, a temporary one is made, but only on a local master: on a
    cluster each executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_written: list[str] = []  # the tables that materialize() made and nothing has deleted


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage is
    cut, nothing depends on an executor's disk, and later reads prune columns. All
    tables of an application lie in one folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that materialize() made and nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._table)


def _delete(spark: SparkSession, table: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if table in _written:
        _written.remove(table)


def release_since(spark: SparkSession, mark: int, *but: DataFrame) -> None:
    """Delete the tables written since written() was `mark`, except those named: what an
    operator's lazy result still reads can only go once that result is written."""
    for table in [t for t in _written[mark:] if t not in [df._table for df in but]]:
        _delete(spark, table)


def written() -> int:
    return len(_written)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that the operators read; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def hash_sample(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The `most` rows of df with the smallest hash of the keys (all rows, if there are
    fewer). A count sets a threshold first, so that about twice as many rows reach the
    final sort however long df is; where too few pass it, because keys repeat, it is
    widened."""
    n, h = df.count(), F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    share = 2 * most / max(1, n)
    while share < 1:
        near = df.filter(h < int((1 << 40) * share))
        if near.count() >= most:
            return near.orderBy(h, *keys).limit(most)
        share *= 8
    return df.orderBy(h, *keys).limit(most)


def within(rows: list, budget: int, size: Callable) -> list:
    """The rows, in order, whose joint size stays in the budget; the smallest row alone
    where none does."""
    out, used = [], 0
    for row in rows:
        if used + size(row) <= budget:
            out.append(row)
            used += size(row)
    return out or ([min(rows, key=size)] if rows else [])


_forget: dict[str, Callable[[], None]] = {}


def own_worker(name: str, forget: Callable[[], None]) -> None:
    """Say that this Python worker now runs operator `name`, whose caches `forget`
    empties. Workers are reused, so what another operator kept is dropped here."""
    others = [x for x in _forget if x != name]
    for other in others:
        _forget.pop(other)()
    if others:
        give_back()
    _forget[name] = forget


def give_back() -> None:
    """Return freed memory to the system: the JVM and other workers share the machine."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def small_batches(it: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices with about `limit` bytes in a column, so that Python objects
    are made for one slice at a time."""
    for batch in it:
        if batch.num_rows:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cut = np.flatnonzero(np.diff(size // limit)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                yield batch.slice(a, b - a)
    give_back()


def by_bytes(texts, limit: int = 4 << 20):
    """Index ranges of consecutive texts with about `limit` characters each, so
    that temporary arrays stay small however long the texts are."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, k
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


HOT_ROWS = 1 << 20  # rows of one key that a task of a shuffled join may get
HOT_KEYS = 1 << 17  # keys that may be broadcast


def join_by_group(rows: DataFrame, groups: DataFrame, keys: list[str], size_col: str, total: int, how: str = "inner") -> DataFrame:
    """Equi-join rows with groups (one row per key combination, size_col = number
    of rows that carry it), safe for hot keys.

    Groups over a limit are broadcast, so that their rows never move. The limit is
    1/256 of all rows, but HOT_ROWS at most as long as that leaves no more than
    HOT_KEYS such groups: total / limit bounds how many there can be. All other keys
    are small by definition and go through an ordinary shuffled join.
    """
    limit = hot_limit(total)
    hot = F.broadcast(groups.filter(F.col(size_col) > limit))
    cold = groups.filter(F.col(size_col) <= limit)
    return rows.join(hot, keys, how).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how))


def hot_limit(total: int) -> int:
    return max(1, min(total // 256, max(HOT_ROWS, total // HOT_KEYS)))


SMALL_ROWS = 1 << 20  # ids that may be broadcast


def only_ids(rows: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key is in ids: a broadcast if ids, a materialized table, has at
    most SMALL_ROWS rows, else a shuffled join, which splits hot keys of rows."""
    return rows.join(F.broadcast(ids) if ids.count() <= SMALL_ROWS else ids, on, "left_semi")
