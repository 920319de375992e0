"""Checks of built tables. Each returns a one-row DataFrame or a number of violations,
computed where the data is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.exprs import exact_sum


def violations(df: DataFrame, broken: dict[str, Column]) -> DataFrame:
    """One row with the number of rows that break each named condition, in one pass."""
    return df.agg(*[F.count(F.when(c, 1)).alias(name) for name, c in broken.items()])


def null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return violations(df, {k: F.col(k).isNull() for k in keys})


def duplicate_keys(df: DataFrame, keys: list[str]) -> int:
    """Keys that occur more than once."""
    return df.groupBy(*keys).count().filter("count > 1").count()


def negative_amounts(df: DataFrame, columns: list[str], tolerance: float = 0.001) -> DataFrame:
    return violations(df, {c: F.col(c) < -tolerance for c in columns})


def window_order(df: DataFrame, columns: list[str], tolerance: float = 0.001) -> DataFrame:
    """Rows where a shorter window exceeds the next longer one."""
    return violations(df, {f"{a}_over_{b}": F.col(a) > F.col(b) + tolerance for a, b in zip(columns, columns[1:], strict=False)})


def orphan_share(child: DataFrame, parent: DataFrame, keys: list[str]) -> float:
    total = child.count()
    return child.join(parent.select(*keys), keys, "left_anti").count() / total if total else 0.0


def sums_agree(mart: DataFrame, source: DataFrame, mart_column: str, source_column: str, tolerance: float = 1.0) -> DataFrame:
    """One row: both exact sums and whether they agree."""
    both = mart.agg(exact_sum(mart_column).alias("mart_sum")).crossJoin(source.agg(exact_sum(source_column).alias("source_sum")))
    return both.withColumn("agrees", F.abs(F.col("mart_sum") - F.col("source_sum")) <= tolerance)


@dataclass(frozen=True)
class Band:
    """The range a metric should lie in. A band catches what a bound does not: a
    collapsed table still has more than no rows."""

    low: float
    high: float

    def holds(self, value: float | None) -> bool:
        return value is not None and self.low <= value <= self.high


def out_of_band(record: dict, bands: dict[str, Band]) -> list[str]:
    return [name for name, band in bands.items() if not band.holds(record.get(name))]
