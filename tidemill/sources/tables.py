"""Reading and writing tables: CSV, JSON lines and Parquet with explicit schemas, and
writers that are safe to run again."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A CSV folder with a header. With a schema, malformed and empty values are null;
    without one, every column is a string. Nothing is inferred."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_optional(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at path, or None if there is none. Other errors are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small relation from literal rows."""
    return spark.createDataFrame(rows, schema)


def register_views(tables: dict[str, DataFrame | None]) -> list[str]:
    """Register every table that was found as a temporary view; returns their names."""
    found = [(name, df) for name, df in tables.items() if df is not None]
    for name, df in found:
        df.createOrReplaceTempView(name)
    return [name for name, _ in found]


def stream_json(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """An unbounded table over the JSON files that land in a folder, each read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def stream_parquet(spark: SparkSession, folder: str, file_glob: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """The same over Parquet files of a folder whose names match file_glob."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file_glob).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def stream_kafka(spark: SparkSession, servers: str, topic: str, schema: StructType) -> DataFrame:
    """JSON values of a Kafka topic as an unbounded table; needs Spark's Kafka connector
    on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("v")).select("v.*")


class SelfOverwrite(ValueError):
    """The target of a write is among the files that it would read."""


def _same_or_under(path: str, target: str) -> bool:
    bare = lambda p: p.split(":", 1)[-1].rstrip("/").replace("//", "/") if "://" in p or p.startswith("file:") else p.rstrip("/")
    a, b = bare(path).lstrip("/"), bare(target).lstrip("/")
    return a == b or a.startswith(b + "/")


def input_roots(df: DataFrame) -> list[str]:
    """The folders and files that df reads, as they were named to the readers: a few
    paths, however many files lie below them."""
    leaves, roots = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            found = leaf.relation().location().rootPaths()
            roots += [found.apply(i).toString() for i in range(found.size())]
    return roots


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite", dynamic: bool = False, tidy: bool = False, max_records: int | None = None, files: int | None = None) -> DataFrame:
    """Write Parquet and return the table read back.

    dynamic replaces only the partitions that df has rows for, as an option of this
    write rather than of the session. tidy puts each partition value in one task, so
    one file (or as many as max_records allows). files coalesces. An overwrite whose
    target is, holds or lies in an input of df is refused before anything is deleted.
    """
    if mode == "overwrite" and any(_same_or_under(r, path) or _same_or_under(path, r) for r in input_roots(df)):
        raise SelfOverwrite(f"{path} is an input of the table that would overwrite it")
    if tidy and partition_by:
        df = df.repartition(*partition_by)
    if files:
        df = df.coalesce(files)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if dynamic:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # a partitioned table can be without files


def ingest_csv(spark: SparkSession, landing: str, schema: StructType, bronze: str) -> DataFrame:
    """A landing folder of CSV files, read with an explicit schema and kept as Parquet."""
    return write_table(read_csv(spark, landing, schema), bronze)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def verify_written(df: DataFrame, path: str) -> tuple[int, int, bool]:
    """(rows meant, rows found, whether names and types agree) of a written table."""
    back = df.sparkSession.read.parquet(path)
    kinds = lambda x: sorted((f.name, f.dataType.simpleString()) for f in x.schema)
    return df.count(), back.count(), kinds(df) == kinds(back)


def replace_window(df: DataFrame, path: str, partition: str, low: str, high: str) -> DataFrame:
    """Rewrite the partitions low..high (both included) of a table partitioned by a
    date. Partitions of the window that df has no rows for are removed as well, which
    a dynamic overwrite alone leaves in place; all others stay untouched."""
    spark = df.sparkSession
    inside = F.col(partition).between(F.lit(low).cast("date"), F.lit(high).cast("date"))
    out = df.filter(inside).persist()
    try:
        new = {r[0] for r in out.select(F.col(partition).cast("string")).distinct().collect()}
        old = read_optional(spark, path)
        stale = [] if old is None else [r[0] for r in old.filter(inside).select(F.col(partition).cast("string")).distinct().collect()]
        write_table(out, path, [partition], dynamic=True)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        for value in set(stale) - new:
            folder = hadoop(f"{path}/{partition}={value}")
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
        return spark.read.schema(df.schema).parquet(path)
    finally:
        out.unpersist()
