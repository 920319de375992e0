import json
import os
import time

from pyspark.sql import functions as F

from tidemill.sources.tables import stream_json
from tidemill.streaming import clicks

SCHEMA = "event_ts timestamp, event_type string"


def _drop(folder, name, times, at):
    path = folder / name
    path.write_text("".join(json.dumps({"event_ts": f"2026-07-04T{t}Z", "event_type": "view"}) + "\n" for t in times))
    os.utime(path, (at, at))


def _counts(spark, folder):
    from pyspark.sql.types import StringType, StructField, StructType, TimestampType

    schema = StructType([StructField("event_ts", TimestampType()), StructField("event_type", StringType())])
    return clicks.windowed_counts(stream_json(spark, f"file://{folder}", schema), late="2 minutes")


def _batch(spark, path, n):
    df = spark.read.parquet(f"{path}/batch={n}")
    return {r["w"]: r["n"] for r in df.select(F.date_format("window_start", "HH:mm").alias("w"), "n").collect()}


def test_late_rows_resume_and_eviction(spark, tmp_path):
    folder, out, state = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    folder.mkdir()
    _drop(folder, "f0.json", ["12:00:10", "12:00:50"], 1_000)
    _drop(folder, "f1.json", ["12:10:00"], 2_000)
    _drop(folder, "f2.json", ["12:00:30", "12:08:30", "12:09:00"], 3_000)
    clicks.drain(_counts(spark, folder), out, state, "update")
    assert _batch(spark, out, 0) == {"12:00": 2} and _batch(spark, out, 1) == {"12:10": 1}
    # the late filter lags a batch, so the late row still counts here
    assert _batch(spark, out, 2) == {"12:00": 3, "12:08": 1, "12:09": 1}
    again = clicks.drain(_counts(spark, folder), out, state, "update")
    assert sum(p.numInputRows for p in again.recentProgress) == 0
    _drop(folder, "f3.json", ["12:00:20", "12:20:00"], 4_000)
    last = clicks.drain(_counts(spark, folder), out, state, "update")
    assert _batch(spark, out, 3) == {"12:20": 1}
    assert clicks.dropped_late(last) > 0


def test_append_emits_final_windows_only(spark, tmp_path):
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    folder.mkdir()
    for k, times in enumerate((["12:00:10", "12:00:50"], ["12:10:00"], ["12:20:00"])):
        _drop(folder, f"f{k}.json", times, 1_000 * (k + 1))
    clicks.drain(_counts(spark, folder), out, f"file://{tmp_path}/state", "append")
    rows = spark.read.parquet(out).select(F.date_format("window_start", "HH:mm").alias("w"), "n").collect()
    assert {(r["w"], r["n"]) for r in rows} == {("12:00", 2), ("12:10", 1)}


def test_complete_drain_equals_batch(spark, tmp_path, rows):
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    folder.mkdir()
    _drop(folder, "a.json", ["12:00:10", "12:01:50", "12:30:00"], 1_000)
    _drop(folder, "b.json", ["12:00:59"], 2_000)
    counts = _counts(spark, folder)
    clicks.drain(counts, out, f"file://{tmp_path}/state")
    batch = clicks.windowed_counts(spark.read.schema(SCHEMA).json(f"file://{folder}"))
    assert rows(clicks.drained(spark, out, counts)) == rows(batch)
    assert {r["minute"] for r in clicks.with_minute_label(batch).collect()} == {"12:00", "12:01", "12:30"}


def test_live_query_and_sessions(spark, tmp_path, rows):
    folder = tmp_path / "in"
    folder.mkdir()
    _drop(folder, "a.json", ["12:00:10", "12:00:40", "12:05:00"], 1_000)
    query = clicks.live(_counts(spark, folder), "live_counts", f"file://{tmp_path}/state", every="200 milliseconds")
    try:
        deadline = time.time() + 30
        while time.time() < deadline and spark.table("live_counts").count() < 2:
            time.sleep(0.2)
        assert spark.table("live_counts").agg(F.sum("n")).first()[0] == 3
    finally:
        query.stop()
    events = spark.read.schema(SCHEMA).json(f"file://{folder}")
    assert rows(clicks.session_counts(events, "event_ts", "event_type", "1 minute"), "n") == [(1,), (2,)]
    assert clicks.windowed_counts(events, width="2 minutes", slide="1 minute").agg(F.sum("n")).first()[0] == 6
