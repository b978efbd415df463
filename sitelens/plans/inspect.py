"""Physical-plan inspection: what a user checks with ``explain("formatted")``,
as functions tests can assert on."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

BANNED = ("CartesianProduct", "BroadcastNestedLoopJoin")


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def join_strategies(df: DataFrame) -> list[str]:
    """Join operators in the (initial adaptive) physical plan."""
    return re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)",
                      physical_plan(df))


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", physical_plan(df))


def assert_no_cross_product(df: DataFrame) -> None:
    plan = physical_plan(df)
    bad = [b for b in BANNED if b in plan]
    if bad:
        raise AssertionError(f"plan contains {bad}")
