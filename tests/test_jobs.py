"""Command lines, each in a process of its own: the spill threshold and the UI are
settings that a session starts with."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

from tidemill import jobs

ROOT = Path(__file__).resolve().parents[1]


def run(*args: str) -> dict:
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.showConsoleProgress=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", "tidemill.jobs", *args], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return json.loads(done.stdout.strip().splitlines()[-1])


@pytest.fixture(scope="module")
def lake(tmp_path_factory) -> Path:
    out = tmp_path_factory.mktemp("lake")
    rows = run("generate", "--out", str(out), "--scale", "0.2", "--days", "20", "--seed", "7")
    assert rows["customers"] == 2_000 and rows["orders"] == 20_000 and rows["order_items"] > rows["orders"]
    return out


def test_the_window_of_the_command_line_is_rebuilt(lake, spark):
    found = run("revenue", "--tables", str(lake), "--out", str(lake / "mart"), "--start", "2026-01-03", "--end", "2026-01-05")
    mart = spark.read.parquet(str(lake / "mart"))
    assert found["rows_in_window"] == mart.count() > 0
    assert sorted(str(r[0]) for r in mart.select("order_date").distinct().collect()) == ["2026-01-03", "2026-01-04", "2026-01-05"]


def test_a_measured_run_has_the_shuffle_bytes_of_the_rest_api(lake):
    found = run("measure", "--tables", str(lake), "--out", str(lake / "whole"), "--log", str(lake / "log.jsonl"))
    assert found["shuffle_write_mb"] > 0 and found["shuffle_read_mb"] > 0
    # a fiftieth of the rows that the bands are meant for
    assert "input_items" in found["out_of_band"]


def test_a_forced_spill_spills(lake):
    found = run("spill", "--tables", str(lake), "--threshold", "1000")
    assert found["disk_bytes"] > 0 and found["memory_bytes"] > 0


@pytest.mark.parametrize("args", [["revenue", "--tables", "x", "--out", "y", "--start", "2026-13-01", "--end", "2026-01-05"], ["revenue", "--tables", "x", "--out", "y"], []])
def test_a_wrong_command_line_is_refused(args):
    with pytest.raises(SystemExit):
        jobs.parser().parse_args(args)
