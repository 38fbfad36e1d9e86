"""First-week engagement, the bands built on it, and how it relates to completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursepulse.functions import (
    band_of,
    band_rank,
    days_between,
    fraction_true,
    last_touch,
    percent,
    percent_true,
)
from coursepulse.functions.bands import Bands
from coursepulse.model import AT_RISK_BELOW, BANDS, LEARNER_KEYS, NO_BAND
from coursepulse.operators.joins import join_per_run
from coursepulse.operators.learners import (
    engagement_aggregates,
    engagement_measures,
    enrolled_learners,
    summary_measures,
)

WEEK1_COLUMNS = (
    "week1_steps_visited",
    "week1_steps_completed",
    "week1_first_visit",
    "week1_last_visit",
    "week1_max_step",
    "week1_total_steps",
    "week1_completion_rate",
    "week1_duration_days",
    "week1_engagement_level",
)


def _week_aggregates(week: int) -> list[Column]:
    """Aggregates over the rows of one week; rows of other weeks add nothing."""
    here = F.col("week_number") == week
    return [
        F.count_if(here).alias("week1_steps_visited"),
        F.count_if(here & F.col("step_completed")).alias("week1_steps_completed"),
        F.min(F.when(here, F.col("first_visited_at"))).alias("week1_first_visit"),
        F.max(F.when(here, last_touch())).alias("week1_last_visit"),
        F.max(F.when(here, F.col("step_number"))).alias("week1_max_step"),
    ]


def _week_measures(bands: Bands) -> tuple[dict[str, Column], dict[str, Column]]:
    """Rate and duration first, then the band, which reads the rate."""
    return (
        {
            "week1_completion_rate": percent("week1_steps_completed", "week1_total_steps"),
            "week1_duration_days": days_between("week1_first_visit", "week1_last_visit"),
        },
        {"week1_engagement_level": band_of("week1_completion_rate", bands)},
    )


def week1_metrics(
    week_activity: DataFrame,
    week_steps_per_run: DataFrame,
    week: int = 1,
    bands: Bands = BANDS,
) -> DataFrame:
    """One row per (run, learner) active in the week."""
    metrics = week_activity.groupBy(*LEARNER_KEYS).agg(*_week_aggregates(week))
    metrics = join_per_run(metrics, week_steps_per_run)
    for columns in _week_measures(bands):
        metrics = metrics.withColumns(columns)
    return metrics


def _fill_inactive(learners: DataFrame, bands: Bands) -> DataFrame:
    filled = learners.withColumns(
        {
            "week1_steps_visited": F.coalesce(F.col("week1_steps_visited"), F.lit(0)),
            "week1_steps_completed": F.coalesce(F.col("week1_steps_completed"), F.lit(0)),
            "week1_completion_rate": F.coalesce(F.col("week1_completion_rate"), F.lit(0.0)),
            "week1_engagement_level": F.coalesce(F.col("week1_engagement_level"), F.lit(NO_BAND)),
        }
    )
    return filled.withColumn("week1_level_rank", band_rank("week1_engagement_level", bands))


def attach_week1(summary: DataFrame, metrics: DataFrame, bands: Bands = BANDS) -> DataFrame:
    """Add first-week columns to every learner; those without get zeros and the band None."""
    joined = summary.join(metrics.select(*LEARNER_KEYS, *WEEK1_COLUMNS), list(LEARNER_KEYS), "left")
    return _fill_inactive(joined, bands)


def learner_with_week1(
    enrolments: DataFrame,
    clean: DataFrame,
    sizes: DataFrame,
    week: int = 1,
    bands: Bands = BANDS,
) -> DataFrame:
    """The same table as ``attach_week1`` from one aggregation of the activity.

    Course and first-week measures share a grouping, so one shuffle and one join replace the
    two of each that building them apart would take.
    """
    features = (
        clean.groupBy(*LEARNER_KEYS)
        .agg(*engagement_aggregates(), *_week_aggregates(week))
        .withColumns(engagement_measures())
    )
    joined = enrolled_learners(enrolments).join(features, list(LEARNER_KEYS), "left")
    joined = join_per_run(joined, sizes).withColumns(summary_measures())
    was_active = F.col("week1_steps_visited") > 0
    joined = joined.withColumn("week1_total_steps", F.when(was_active, F.col("week1_total_steps")))
    for columns in _week_measures(bands):
        joined = joined.withColumns(columns)
    return _fill_inactive(joined, bands)


def week1_active_learners(learners: DataFrame) -> DataFrame:
    """Learners who visited at least one step of the week."""
    return learners.where("week1_steps_visited > 0")


def week1_summary(learners: DataFrame) -> DataFrame:
    """One row: learners, those active in the week, and their share."""
    active = F.col("week1_steps_visited") > 0
    return learners.agg(
        F.count(F.lit(1)).alias("n_enrolled"),
        F.count_if(active).alias("n_week1_active"),
        fraction_true(active).alias("prop_week1_active"),
    )


def week1_by_completion(week1_active: DataFrame) -> DataFrame:
    """First-week steps and rate of completers and others."""
    return week1_active.groupBy("completed").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("week1_steps_completed").alias("mean_week1_steps_completed"),
        F.median("week1_steps_completed").alias("median_week1_steps_completed"),
        F.avg("week1_completion_rate").alias("mean_week1_completion_rate"),
    )


def completion_by_level(week1_active: DataFrame, by_run: bool = False) -> DataFrame:
    """Learners and completion rate (0 to 1) per band, on request within each run."""
    run = ["course_run"] if by_run else []
    return week1_active.groupBy(*run, "week1_engagement_level", "week1_level_rank").agg(
        F.count(F.lit(1)).alias("n"),
        fraction_true("completed").alias("completion_rate"),
    )


def completion_by_level_percent(week1_active: DataFrame) -> DataFrame:
    """Learners, completers and completion percentage per band."""
    return week1_active.groupBy("week1_engagement_level", "week1_level_rank").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("completed").alias("n_completed"),
        percent_true("completed").alias("completion_rate"),
    )


def completion_by_week1_steps(week1_active: DataFrame, min_group: int = 10) -> DataFrame:
    """Completion percentage per number of first-week steps, small groups left out."""
    return (
        week1_active.groupBy("week1_steps_completed")
        .agg(F.count(F.lit(1)).alias("n"), percent_true("completed").alias("completion_rate"))
        .where(F.col("n") >= min_group)
    )


def at_risk(
    learners: DataFrame, below: float = AT_RISK_BELOW, include_inactive: bool = False
) -> DataFrame:
    """Learners who did less than ``below`` percent of the week.

    Those with no first-week activity at all are listed only on request.
    """
    flagged = learners.where(F.col("week1_completion_rate") < below)
    if not include_inactive:
        flagged = flagged.where("week1_steps_visited > 0")
    return flagged.select(*LEARNER_KEYS, "week1_completion_rate", "week1_engagement_level")
