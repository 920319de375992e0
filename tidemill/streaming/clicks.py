"""Event-time counts, defined once for batch and stream, and ways to run the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, ts: str = "event_ts", key: str = "event_type", width: str = "1 minute", late: str | None = None, slide: str | None = None) -> DataFrame:
    """Events by window and key. `late` sets a watermark (streams need one to forget);
    a timestamp without zone is read in the session's zone. slide makes windows overlap."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if late is not None:
        events = events.withWatermark(ts, late)
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n")


def session_counts(events: DataFrame, ts: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """Events by session window: a session ends after a gap without events."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if late is not None:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n")


def with_minute_label(counts: DataFrame) -> DataFrame:
    return counts.withColumn("minute", F.date_format("window_start", "HH:mm"))


def drain(counts: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Read what is there and stop. Every batch is written to path under its number, so
    a batch that runs again replaces itself; complete mode keeps the last one only.
    Running again with the checkpoint goes on where the last run ended."""

    def write(batch: DataFrame, number: int) -> None:
        target = path if mode == "complete" else f"{path}/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    query = counts.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return query


def drained(spark: SparkSession, path: str, counts: DataFrame) -> DataFrame:
    """What drain() has written."""
    return spark.read.schema(counts.schema).parquet(path)


def live(counts: DataFrame, name: str, checkpoint: str, every: str = "4 seconds", mode: str = "update", sink: str = "memory") -> StreamingQuery:
    """Start a query that runs until stopped, into a memory table or the console."""
    writer = counts.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=every).format(sink)
    if sink == "console":
        writer = writer.option("truncate", False).option("numRows", 50)
    return writer.queryName(name).start()


def dropped_late(query: StreamingQuery) -> int:
    """Rows that came after their window was final, over all reported batches."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
