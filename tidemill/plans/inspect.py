"""What the optimizer decided, as text and as facts to assert on."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame


def explained(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as explain() prints it (simple, extended, formatted, cost)."""
    execution = df._jdf.queryExecution()
    return execution.explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


@dataclass(frozen=True)
class PlanFacts:
    exchanges: int
    broadcasts: int
    joins: dict[str, int]
    pushed: list[str]
    partition_filters: list[str]
    read_columns: list[list[str]]
    group_limits: int


def plan_facts(df: DataFrame) -> PlanFacts:
    text = df._jdf.queryExecution().executedPlan().toString()
    kinds = ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct")
    return PlanFacts(
        exchanges=len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange (?:hash|range|Single|RoundRobin)", text)),
        broadcasts=text.count("BroadcastExchange"),
        joins={k: n for k in kinds if (n := len(re.findall(rf"\b{k}\b", text)))},
        pushed=re.findall(r"PushedFilters: \[([^\]]*)\]", text),
        partition_filters=re.findall(r"PartitionFilters: \[([^\]]*)\]", text),
        read_columns=[re.findall(r"(\w+):", s) for s in re.findall(r"ReadSchema: struct<([^>]*)>", text)],
        group_limits=text.count("WindowGroupLimit"),
    )
