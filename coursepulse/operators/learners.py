"""Per-learner engagement over the whole course, and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursepulse.functions import days_between, fraction_true, last_touch, percent
from coursepulse.model import DEMOGRAPHICS, LEARNER_KEYS, UNKNOWN
from coursepulse.operators.joins import join_per_run

_COUNTS = ("total_steps_visited", "total_steps_completed", "num_weeks_active", "max_week_reached")


def engagement_aggregates() -> list[Column]:
    """Aggregates over the cleaned steps of one learner in one run.

    Weeks are counted with NULL as a week of its own. A learner's set of weeks is at most as long
    as the course, so it is gathered in the grouping; counting distinct weeks would shuffle by week first.
    """
    return [
        F.count(F.lit(1)).alias("total_steps_visited"),
        F.count_if("step_completed").alias("total_steps_completed"),
        F.min("first_visited_at").alias("first_activity"),
        F.max(last_touch()).alias("last_activity"),
        (
            F.size(F.collect_set("week_number")).cast("long") + F.max(F.col("week_number").isNull().cast("int"))
        ).alias("num_weeks_active"),
        F.max("week_number").alias("max_week_reached"),
    ]


def engagement_measures() -> dict[str, Column]:
    """Columns computed from ``engagement_aggregates``."""
    return {
        "avg_steps_per_week": F.col("total_steps_visited") / F.col("num_weeks_active"),
        "engagement_duration_days": days_between("first_activity", "last_activity"),
    }


def learner_engagement(clean: DataFrame) -> DataFrame:
    """One row per (run, learner) with any activity."""
    return (
        clean.groupBy(*LEARNER_KEYS)
        .agg(*engagement_aggregates())
        .withColumns(engagement_measures())
    )


def enrolled_learners(enrolments: DataFrame) -> DataFrame:
    """The enrolment columns a learner table carries."""
    return enrolments.select(
        "learner_id",
        "course_run",
        "enrolled_at",
        "fully_participated_at",
        *(F.nullif(F.col(c), F.lit(UNKNOWN)).alias(c) for c in DEMOGRAPHICS),
    )


def summary_measures() -> dict[str, Column]:
    """Completion flag, zeros for the inactive, and completion percentage, in that order."""
    return {
        "completed": F.col("fully_participated_at").isNotNull(),
        **{c: F.coalesce(F.col(c), F.lit(0)) for c in _COUNTS},
        "completion_percentage": percent(
            F.coalesce(F.col("total_steps_completed"), F.lit(0)), "total_steps_in_course"
        ),
    }


def learner_summary(
    enrolments: DataFrame,
    engagement: DataFrame,
    steps_per_run: DataFrame,
) -> DataFrame:
    """One row per enrolment with demographics, engagement and completion.

    Activity of people who are not enrolled does not appear.
    """
    joined = enrolled_learners(enrolments).join(engagement, list(LEARNER_KEYS), "left")
    return join_per_run(joined, steps_per_run).withColumns(summary_measures())


def active_learners(summary: DataFrame) -> DataFrame:
    """Learners who visited at least one step."""
    return summary.where("total_steps_visited > 0")


def completion_overall(summary: DataFrame) -> DataFrame:
    """One row: enrolled, active and completed learners, and the completion rate."""
    return summary.agg(
        F.count(F.lit(1)).alias("n_enrolled"),
        F.count_if(F.col("total_steps_visited") > 0).alias("n_active"),
        F.count_if("completed").alias("n_completed"),
        fraction_true("completed").alias("completion_rate"),
    )


def engagement_by_completion(active: DataFrame) -> DataFrame:
    """Mean and median steps and mean weeks of completers and others.

    The exact median keeps one count per distinct step count, of which there are at most as
    many as a course has steps.
    """
    return active.groupBy("completed").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("total_steps_completed").alias("mean_steps_completed"),
        F.median("total_steps_completed").alias("median_steps_completed"),
        F.avg("num_weeks_active").alias("mean_weeks_active"),
    )


def median_steps_by_completion(active: DataFrame) -> DataFrame:
    """Median completed steps of completers and others."""
    return active.groupBy("completed").agg(
        F.median("total_steps_completed").alias("median_steps")
    )


def completion_by_demographic(
    summary: DataFrame, demographic: str, min_group: int = 30
) -> DataFrame:
    """Completion percentage per value of one demographic, small groups left out."""
    if demographic not in DEMOGRAPHICS:
        raise ValueError(f"unknown demographic {demographic!r}; use one of {DEMOGRAPHICS}")
    return (
        summary.where(F.col(demographic).isNotNull())
        .groupBy(F.col(demographic).alias("demographic"))
        .agg(F.count(F.lit(1)).alias("n"), (fraction_true("completed") * 100).alias("completion_rate"))
        .where(F.col("n") >= min_group)
        .orderBy(F.desc_nulls_last("completion_rate"), "demographic")
    )


def missing_demographics(summary: DataFrame) -> DataFrame:
    """Number of learners with no value, per demographic."""
    counts = summary.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in DEMOGRAPHICS))
    return counts.unpivot([], list(DEMOGRAPHICS), "demographic", "n_missing")


def completed_by_steps(summary: DataFrame, min_percentage: float = 80) -> DataFrame:
    """Overall counts under the other definition of completion: a share of the steps done."""
    reached = F.coalesce(F.col("completion_percentage") >= min_percentage, F.lit(False))
    return summary.agg(
        F.count(F.lit(1)).alias("n_enrolled"),
        F.count_if(reached).alias("n_completed"),
        fraction_true(reached).alias("completion_rate"),
    )
