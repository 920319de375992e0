"""One record per run of a job, appended to a log, and the guard over the latest one."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidemill.operators.checks import Band, out_of_band
from tidemill.plans.layout import layout_of
from tidemill.session import job_description

# The bands of the daily mart at scale 10.
MART_BANDS = {"output_rows": Band(8_000, 12_000), "input_items": Band(2_400_000, 2_600_000), "runtime_s": Band(0, 120), "output_files": Band(0, 300)}


def shuffle_bytes(spark: SparkSession) -> tuple[float | None, float | None]:
    """(read, written) shuffle bytes of all stages by the REST API; None without a UI."""
    if not spark.sparkContext.uiWebUrl:
        return None, None
    url = f"{spark.sparkContext.uiWebUrl}/api/v1/applications/{spark.sparkContext.applicationId}/stages"
    try:
        with urllib.request.urlopen(url, timeout=5) as answer:
            stages = json.load(answer)
    except (urllib.error.URLError, OSError, ValueError):
        return None, None
    return sum(s.get("shuffleReadBytes", 0) for s in stages), sum(s.get("shuffleWriteBytes", 0) for s in stages)


def measure(spark: SparkSession, job: str, inputs: dict[str, DataFrame], run: Callable[[], str], extra: dict | None = None) -> dict:
    """Run a job that returns the path it has written, and describe the run. Output
    rows are counted from the written table, not by computing it again."""
    read_before, written_before = shuffle_bytes(spark)
    begin = time.perf_counter()
    with job_description(spark, job):
        path = run()
    record: dict = {"ts": datetime.now(UTC).isoformat(timespec="seconds"), "job": job, "runtime_s": time.perf_counter() - begin}
    record |= {f"input_{name}": df.count() for name, df in inputs.items()}
    read, written = shuffle_bytes(spark)
    found = layout_of(spark, path)
    record |= {"output_rows": spark.read.parquet(path).count(), "output_files": found.files, "output_mb": found.bytes / 1e6}
    record |= {"shuffle_read_mb": None if read is None or read_before is None else (read - read_before) / 1e6, "shuffle_write_mb": None if written is None or written_before is None else (written - written_before) / 1e6}
    return record | (extra or {})


def append_record(path: str | Path, record: dict) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(record, default=str) + "\n")


def latest_record(path: str | Path, job: str | None = None) -> dict | None:
    """The last record of the log (of a job), or None if there is none."""
    if not Path(path).exists():
        return None
    records = [json.loads(line) for line in Path(path).read_text(encoding="utf-8").splitlines() if line]
    records = [r for r in records if job is None or r.get("job") == job]
    return records[-1] if records else None


def check_latest(path: str | Path, bands: dict[str, Band] = MART_BANDS, job: str | None = None) -> list[str] | None:
    """Names of the latest record's metrics that are out of band; None without a record."""
    record = latest_record(path, job)
    return None if record is None else out_of_band(record, bands)
