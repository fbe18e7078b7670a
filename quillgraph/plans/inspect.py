"""What a DataFrame's physical plan holds, for tests and for tuning."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

#: Operators worth counting.
WATCHED = (
    "Exchange",
    "BroadcastExchange",
    "BroadcastHashJoin",
    "SortMergeJoin",
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "ArrowEvalPython",
    "BatchEvalPython",
    "MapInArrow",
    "MapInPandas",
    "Window",
    "ReusedExchange",
)


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"),
    )


def operators(df: DataFrame) -> Counter:
    """How often each watched operator occurs in the plan as it would start."""
    tree = plan_text(df).split("\n\n\n")[0]
    found = Counter(re.findall(r"[A-Z]\w+", "\n".join(line for line in tree.splitlines() if "(" in line)))
    return Counter({name: found[name] for name in WATCHED if found[name]})


def scanned_columns(df: DataFrame) -> list[set[str]]:
    """The columns that each file scan reads."""
    return [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<([^>]*)>", plan_text(df))]


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[(.*)\]", plan_text(df))
