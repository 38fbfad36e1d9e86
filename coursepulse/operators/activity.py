"""Step activity: duplicates, the cleaned table, and what a run consists of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursepulse.functions import last_touch
from coursepulse.model import STEP_KEYS


def duplicate_groups(activity: DataFrame) -> DataFrame:
    """(run, learner, step) keys recorded more than once, with their row count."""
    return activity.groupBy(*STEP_KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def clean_step_activity(activity: DataFrame, step_fixes_week: bool = False) -> DataFrame:
    """Keep the most recently touched row of every (run, learner, step).

    Rows touched at the same moment are told apart by completion, then by first visit, then by
    the remaining columns, so the outcome depends on neither file nor task order. ``max`` over
    a struct is combined before the shuffle: a key repeated a billion times sends one row per
    map task. The aggregate sorts, since a struct has no fixed width, but needs one shuffle.

    With ``step_fixes_week`` the caller states that a step of a run always has the same week
    and step number (``model.inconsistent_steps`` lists the exceptions). They then join the
    grouping key, which changes no row but lets a filter on the week reach the scan and lets
    Catalyst drop this aggregate under queries that only need distinct keys and weeks.
    """
    keys = [*STEP_KEYS, *(("week_number", "step_number") if step_fixes_week else ())]
    payload = [c for c in activity.columns if c not in keys and c != "step_completed"]
    order = ["last_completed_at", "first_visited_at"]
    rest = [c for c in payload if c not in order]
    latest = F.max(F.struct(last_touch().alias("last_touch"), *order, *rest))
    columns = [F.col(c) if c in keys else F.col(f"latest.{c}").alias(c) for c in [*keys, *payload]]
    return (
        activity.groupBy(*keys)
        .agg(latest.alias("latest"))
        .select(*columns)
        .withColumn("step_completed", F.col("last_completed_at").isNotNull())
        .select(*activity.columns)
    )


def activity_in_week(clean: DataFrame, week: int = 1) -> DataFrame:
    """Cleaned activity of one course week, with the time of the last touch."""
    return clean.where(F.col("week_number") == week).withColumn("last_touch", last_touch())


def count_steps(clean: DataFrame, name: str = "total_steps_in_course") -> DataFrame:
    """Number of distinct steps per run. Only keys are read, so the dedup below is optimised away."""
    steps = clean.select("course_run", "step").distinct()
    return steps.groupBy("course_run").agg(F.count(F.lit(1)).alias(name))


def run_sizes(clean: DataFrame, week: int = 1) -> DataFrame:
    """Steps of the whole course and of one week per run, from a single pass."""
    in_week = F.coalesce(F.col("week_number") == week, F.lit(False))
    return (
        clean.groupBy("course_run", "step")
        .agg(F.max(in_week).alias("in_week"))
        .groupBy("course_run")
        .agg(
            F.count(F.lit(1)).alias("total_steps_in_course"),
            # A run without steps in that week has no week size, as after a left join.
            F.nullif(F.count_if("in_week"), F.lit(0)).alias("week1_total_steps"),
        )
    )


def never_active(enrolments: DataFrame, activity: DataFrame) -> DataFrame:
    """Distinct learners enrolled and active over all runs, and the difference of the two."""
    active = activity.agg(F.count_distinct("learner_id").alias("n"))
    return enrolments.agg(F.count_distinct("learner_id").alias("enrolled_learners")).select(
        "enrolled_learners",
        active.scalar().alias("active_learners"),
    ).withColumn("never_active", F.col("enrolled_learners") - F.col("active_learners"))
