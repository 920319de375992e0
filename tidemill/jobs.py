"""Jobs with a command line: python -m tidemill.jobs {generate,revenue,measure,spill} ..."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from tidemill.operators import marts
from tidemill.plans import job_metrics, labs
from tidemill.session import get_spark
from tidemill.sources import generate as G
from tidemill.sources.tables import read_table, write_table

#: Rows at scale 1.
CUSTOMERS, ORDERS = 10_000, 100_000


def day(text: str) -> str:
    return date.fromisoformat(text).isoformat()


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidemill.jobs", description=__doc__)
    jobs = out.add_subparsers(dest="job", required=True)
    made = jobs.add_parser("generate", help="write seeded customers, products, orders and items")
    made.add_argument("--out", required=True)
    made.add_argument("--scale", type=float, default=1.0, help="1 is 100,000 orders")
    made.add_argument("--seed", type=int, default=42)
    made.add_argument("--start", type=day, default="2026-01-01")
    made.add_argument("--days", type=int, default=180)
    for name, text in (("revenue", "rebuild the daily revenue mart for a window of dates"), ("measure", "build the whole mart and append a record of the run")):
        job = jobs.add_parser(name, help=text)
        job.add_argument("--tables", required=True)
        job.add_argument("--out", required=True)
        if name == "revenue":
            job.add_argument("--start", type=day, required=True)
            job.add_argument("--end", type=day, required=True)
        else:
            job.add_argument("--log", required=True)
    spill = jobs.add_parser("spill", help="sort the items with a forced spill and report its bytes")
    spill.add_argument("--tables", required=True)
    spill.add_argument("--threshold", type=int, default=2_000, help="rows a sorter holds before it spills")
    return out


def generate(spark: SparkSession, out: str, scale: float, seed: int, start: str, days: int) -> dict[str, int]:
    """Write the four tables under out and return their row counts."""
    buyers, n = max(1, int(CUSTOMERS * scale)), max(1, int(ORDERS * scale))
    write_table(G.customers(spark, buyers, seed), f"{out}/customers")
    write_table(G.products(spark, seed=seed), f"{out}/products")
    orders = write_table(G.orders(spark, n, buyers, seed, start, days), f"{out}/orders")
    write_table(G.order_items(orders, seed=seed), f"{out}/order_items")
    return {name: read_table(spark, f"{out}/{name}").count() for name in ("customers", "products", "orders", "order_items")}


def mart_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(read_table(spark, f"{folder}/{name}") for name in ("order_items", "orders", "products"))


def measured_mart(spark: SparkSession, folder: str, out: str, log: str) -> dict:
    """Build the whole mart, partitioned by date, and append the run's record to the log."""
    items, orders, products = mart_inputs(spark, folder)

    def run() -> str:
        write_table(marts.daily_revenue(items, orders, products), out, ["order_date"], tidy=True)
        return out

    record = job_metrics.measure(spark, "daily_revenue", {"items": items}, run)
    job_metrics.append_record(log, record)
    return record | {"out_of_band": job_metrics.check_latest(log)}


def main(args: list[str] | None = None) -> int:
    """Run one job and print one JSON line about it."""
    a = parser().parse_args(args)
    # a sorter reads its spill threshold from the settings the session starts with
    conf = {"spark__shuffle__spill__numElementsForceSpillThreshold": str(a.threshold)} if a.job == "spill" else {}
    spark = get_spark(f"tidemill-{a.job}", **conf)
    if a.job == "generate":
        found = generate(spark, a.out, a.scale, a.seed, a.start, a.days)
    elif a.job == "revenue":
        mart = marts.rebuild_daily_revenue(*mart_inputs(spark, a.tables), a.out, a.start, a.end)
        found = {"start": a.start, "end": a.end, "rows_in_window": marts.in_window(mart, a.start, a.end).count()}
    elif a.job == "measure":
        found = measured_mart(spark, a.tables, a.out, a.log)
    else:
        found = labs.spill_of(spark, read_table(spark, f"{a.tables}/order_items").orderBy("item_revenue", "order_item_id"))
    print(json.dumps(found, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
