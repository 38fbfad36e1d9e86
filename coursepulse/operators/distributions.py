"""Queries behind the charts: retention, shares, funnel, long forms and thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coursepulse.functions import count_text, percent_text, percent_true

# Chart labels (fixed values).
ENGAGEMENT_METRICS = {
    "total_steps_completed": "Steps Completed",
    "num_weeks_active": "Weeks Active",
    "engagement_duration_days": "Duration (Days)",
}
RATE_PERIODS = {
    "week1_completion_rate": "Week 1 Only",
    "completion_percentage": "Overall Course",
}
THRESHOLDS = tuple(range(0, 101, 10))
LABEL_FROM_PERCENT = 8


def weekly_retention(clean: DataFrame, by_run: bool = False) -> DataFrame:
    """Distinct learners per week, and as a percentage of the first week.

    All runs are pooled, a learner of two runs counting once, unless ``by_run`` is set.
    """
    weeks = clean.groupBy(*(["course_run"] if by_run else []), "week_number").agg(
        F.count_distinct("learner_id").alias("active_learners")
    )
    return retention_of(weeks, by_run)


def retention_of(weeks: DataFrame, by_run: bool = False) -> DataFrame:
    """active_learners per week, on request within each run, with their percentage of the first week."""
    if by_run:
        in_order = W.partitionBy("course_run").orderBy(F.asc_nulls_last("week_number"))
        first_week = F.first("active_learners").over(in_order)
    else:
        # Weeks sort with NULL last, so an unnumbered week is the base only if it is alone.
        first_week = weeks.agg(
            F.coalesce(F.min_by("active_learners", "week_number"), F.max("active_learners"))
        ).scalar()
    retention = weeks.withColumn("retention_rate", F.col("active_learners") / first_week * 100)
    return retention.orderBy(*(["course_run"] if by_run else []), F.asc_nulls_last("week_number"))


def level_distribution(learners: DataFrame) -> DataFrame:
    """Learners per band, their percentage, and a label where the share is large enough."""
    counts = learners.groupBy("week1_engagement_level", "week1_level_rank").agg(
        F.count(F.lit(1)).alias("n")
    )
    total = counts.agg(F.sum("n")).scalar()
    text = F.concat(count_text("n"), F.lit("\n("), percent_text("percentage"), F.lit(")"))
    return counts.withColumn("percentage", F.col("n") / total * 100).withColumn(
        "label", F.when(F.col("percentage") >= LABEL_FROM_PERCENT, text)
    )


def completion_funnel(overall: DataFrame) -> DataFrame:
    """Stages Enrolled, Active, Completed with count, percentage of the enrolled and label."""
    stages = ["Enrolled", "Active", "Completed"]
    text = F.concat(count_text("count"), F.lit("\n("), percent_text("percentage"), F.lit(")"))
    return (
        overall.select(
            F.col("n_enrolled"),
            F.col("n_enrolled").alias("Enrolled"),
            F.col("n_active").alias("Active"),
            F.col("n_completed").alias("Completed"),
        )
        .unpivot("n_enrolled", stages, "stage", "count")
        .select(
            "stage",
            F.array_position(F.array(*map(F.lit, stages)), F.col("stage")).cast("int").alias("stage_rank"),
            "count",
            F.when(F.col("n_enrolled") > 0, F.col("count") / F.col("n_enrolled") * 100).alias("percentage"),
        )
        .withColumn("label", text)
    )


def _long(df: DataFrame, keep: Sequence[str], labels: dict[str, str], name: str, value: str) -> DataFrame:
    """One row per learner and labelled measure."""
    wide = df.select(*keep, *(F.col(c).cast("double").alias(label) for c, label in labels.items()))
    return wide.unpivot(list(keep), list(labels.values()), name, value)


def engagement_long(active: DataFrame) -> DataFrame:
    """Steps, weeks and duration of each learner as (metric, value)."""
    return _long(active, ["course_run", "learner_id", "completed"], ENGAGEMENT_METRICS, "metric", "value")


def week1_vs_overall_long(week1_active: DataFrame) -> DataFrame:
    """First-week and whole-course rate of each learner as (period, completion_pct)."""
    return _long(
        week1_active, ["course_run", "learner_id", "completed"], RATE_PERIODS, "period", "completion_pct"
    )


def threshold_curve(week1_active: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Learners at or above each first-week rate, and their completion percentage.

    One pass over the learners whatever the number of thresholds; a threshold nobody reaches
    keeps its row, with n = 0 and no rate.
    """
    reached = [F.col("week1_completion_rate") >= t for t in thresholds]
    one_row = week1_active.agg(
        percent_true("completed").alias("overall_rate"),
        *(F.count_if(r).alias(f"n_{i}") for i, r in enumerate(reached)),
        *(percent_true(F.when(r, F.col("completed"))).alias(f"rate_{i}") for i, r in enumerate(reached)),
    )
    rows = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.col(f"n_{i}").alias("n"),
            F.col(f"rate_{i}").alias("completion_rate"),
        )
        for i, t in enumerate(thresholds)
    ]
    return one_row.select(F.col("overall_rate"), F.inline(F.array(*rows)))
