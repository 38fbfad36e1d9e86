"""Joins to tables that hold one row per course run."""

from __future__ import annotations

from pyspark.sql import DataFrame


def join_per_run(df: DataFrame, per_run: DataFrame) -> DataFrame:
    """Left join a table of one row per run.

    How many runs there are is known only at run time, so Spark picks the join from the size it
    measures: a broadcast for the usual few runs, else a sort-merge join whose hot runs are split.
    Spark splits only where both sides come straight from a shuffle of the join's own, which a table just
    grouped by run doesn't. Its few rows are therefore dealt out anew in between, which, unlike
    a rewritten key, leaves it known that a run has one row: a join whose columns nobody reads is dropped.
    """
    return df.join(per_run.hint("rebalance"), "course_run", "left")
