"""Column expressions shared by marts and features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def exact_sum(amount: Column | str, kind: str = MONEY) -> Column:
    """A sum of money that does not depend on the order of rows, as double."""
    return F.sum((F.col(amount) if isinstance(amount, str) else amount).cast(kind)).cast("double")


def sum_if(condition: Column, amount: Column | str) -> Column:
    """The exact sum over rows that meet the condition, 0 where none do."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    return F.coalesce(F.sum(F.when(condition, amount.cast(MONEY))), F.lit(0)).cast("double")


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def any_if(condition: Column) -> Column:
    """1 if a row meets the condition, else 0."""
    return F.coalesce(F.max(F.when(condition, 1).otherwise(0)), F.lit(0))


def max_if(condition: Column, value: Column | str) -> Column:
    """The largest value of rows that meet the condition; null where none do."""
    return F.max(F.when(condition, F.col(value) if isinstance(value, str) else value))


def days_between(end: Column, start: Column) -> Column:
    return F.datediff(end, start)


def minute_label(ts: Column | str) -> Column:
    return F.date_format(ts, "HH:mm")


def as_date(text: str) -> Column:
    return F.lit(text).cast("date")
