"""Every query by name, each a function of the derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursepulse.functions import parse_utc
from coursepulse.model import DEMOGRAPHICS
from coursepulse.operators import boxplot, distributions, early, histogram, learners, reach, trend
from coursepulse.plans import report
from coursepulse.plans.course import CourseTables

Query = Callable[[CourseTables], DataFrame]

STEP_BINS = 50
RATE_BINS = 30


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round sums of fractions, whose last bits depend on the order of the rows."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def visit_texts(t: CourseTables) -> DataFrame:
    """Visit times as raw text in the forms a file may hold, and what they parse to.

    The step number decides the form: with and without the suffix, empty, date only, or junk.
    """
    stamp = F.date_format("first_visited_at", "yyyy-MM-dd HH:mm:ss")
    kind = F.col("step_number")
    text = (
        F.when(kind <= 2, F.concat(stamp, F.lit(" UTC")))
        .when(kind <= 4, stamp)
        .when(kind == 5, F.lit(""))
        .when(kind == 6, F.date_format("first_visited_at", "yyyy-MM-dd"))
        .otherwise(F.concat(F.lit("at "), stamp))
    )
    return t.step_activity_all.select("course_run", "learner_id", "step", text.alias("visit_text")).withColumn(
        "visited_at", parse_utc("visit_text")
    )


def any_week(t: CourseTables) -> CourseTables:
    """The same inputs without the statement that a step fixes its week, as for files of unknown origin."""
    return CourseTables(t.step_activity_all, t.enrolments_all, week=t.week, bands=t.bands)


def steps_histogram(t: CourseTables) -> DataFrame:
    active = t.learner_summary_active
    return histogram.histogram(active, "total_steps_completed", ["completed"], STEP_BINS, few_values=True)


def duration_histogram(t: CourseTables) -> DataFrame:
    return histogram.histogram(t.learner_summary_active, "engagement_duration_days", ["completed"], STEP_BINS)


def rates_histogram(t: CourseTables) -> DataFrame:
    long = distributions.week1_vs_overall_long(t.learner_with_week1_active)
    return histogram.histogram(long, "completion_pct", ["period", "completed"], RATE_BINS, few_values=True)


def steps_trend(t: CourseTables) -> DataFrame:
    points = early.completion_by_week1_steps(t.learner_week1_active)
    return trend.local_trend(points, "week1_steps_completed", "completion_rate")


def drawn_trend(t: CourseTables) -> DataFrame:
    points = early.completion_by_week1_steps(t.learner_week1_active)
    curve = trend.drawn_trend(points, "week1_steps_completed", "completion_rate")
    return rounded(curve.withColumnRenamed("x", "week1_steps_completed"), "week1_steps_completed", "trend")


QUERIES: dict[str, Query] = {
    # Inputs and cleaning
    "step_activity_all": lambda t: t.step_activity_all,
    "enrolments_all": lambda t: t.enrolments_all,
    "parse_utc": visit_texts,
    "inactive_summary": lambda t: t.inactive_summary,
    "inactive_summary_merged": lambda t: reach.never_active(t.enrolled_reach, t.week_reach),
    "dup_groups_step_activity": lambda t: t.dup_groups_step_activity,
    "step_activity_clean": lambda t: t.step_activity_clean,
    "steps_per_run": lambda t: t.steps_per_run,
    # Learners
    "learner_engagement": lambda t: t.learner_engagement,
    "learner_summary": lambda t: t.learner_summary,
    "learner_summary_active": lambda t: t.learner_summary_active,
    "completion_overall": lambda t: t.completion_overall,
    "engagement_by_completion": lambda t: t.engagement_by_completion,
    "median_steps_by_completion": lambda t: learners.median_steps_by_completion(t.learner_summary_active),
    "missing_demographics": lambda t: learners.missing_demographics(t.learner_summary),
    "completed_by_steps": lambda t: learners.completed_by_steps(t.learner_summary),
    **{
        f"completion_by_demographic_{d}": (lambda t, d=d: learners.completion_by_demographic(t.learner_summary, d))
        for d in DEMOGRAPHICS
    },
    # First week
    "week1_activity": lambda t: t.week1_activity,
    "week1_steps_per_run": lambda t: t.week1_steps_per_run,
    "week1_metrics": lambda t: t.week1_metrics,
    "learner_with_week1": lambda t: t.learner_with_week1,
    "learner_with_week1_active": lambda t: t.learner_with_week1_active,
    "week1_summary": lambda t: t.week1_summary,
    "week1_by_completion": lambda t: rounded(t.week1_by_completion, "mean_week1_completion_rate"),
    "completion_by_week1_level": lambda t: t.completion_by_week1_level,
    "completion_by_week1_level_by_run": lambda t: early.completion_by_level(t.learner_week1_active, by_run=True),
    "completion_by_week1_level_pct": lambda t: early.completion_by_level_percent(t.learner_week1_active),
    "completion_by_week1_steps": lambda t: early.completion_by_week1_steps(t.learner_week1_active),
    "at_risk_learners": lambda t: early.at_risk(t.learner_week1),
    # Chart data
    "completion_funnel": lambda t: distributions.completion_funnel(t.completion_overall),
    "weekly_retention": lambda t: distributions.weekly_retention(t.step_activity_clean),
    "weekly_retention_by_run": lambda t: distributions.weekly_retention(t.step_activity_clean, by_run=True),
    "weekly_retention_merged": lambda t: reach.weekly_retention(t.week_reach),
    "weekly_retention_by_run_merged": lambda t: reach.weekly_retention(t.week_reach, by_run=True),
    "week1_level_distribution": lambda t: distributions.level_distribution(t.learner_week1),
    "step_activity_clean_any_week": lambda t: any_week(t).step_activity_clean,
    "week1_metrics_any_week": lambda t: any_week(t).week1_metrics,
    "learner_with_week1_any_week": lambda t: any_week(t).learner_with_week1,
    "engagement_long": lambda t: distributions.engagement_long(t.learner_summary_active),
    "week1_vs_overall_long": lambda t: distributions.week1_vs_overall_long(t.learner_with_week1_active),
    "steps_histogram": steps_histogram,
    "steps_histogram_peak": lambda t: histogram.peak(steps_histogram(t)),
    "duration_histogram": duration_histogram,
    "week1_vs_overall_histogram": rates_histogram,
    "engagement_boxplot": lambda t: rounded(
        boxplot.box_statistics(distributions.engagement_long(t.learner_summary_active), boxplot.METRICS),
        "lower_whisker", "q1", "median", "q3", "upper_whisker",
    ),
    "engagement_outliers": lambda t: boxplot.outliers(
        distributions.engagement_long(t.learner_summary_active), boxplot.METRICS
    ),
    "threshold_curve": lambda t: distributions.threshold_curve(t.learner_week1_active),
    "week1_steps_trend": lambda t: rounded(steps_trend(t), "trend"),
    "week1_steps_trend_drawn": drawn_trend,
    # Report
    "enrollment_summary": lambda t: report.enrollment_summary(t.completion_overall, t.learner_summary_active),
    "engagement_table": lambda t: report.engagement_table(t.engagement_by_completion),
    "cycle1_summary": lambda t: report.cycle1_summary(t.learner_summary_active),
    "effect_sizes": lambda t: report.effect_sizes(report.cycle1_summary(t.learner_summary_active)),
    "week1_dist_table": lambda t: report.week1_dist_table(t.learner_week1),
    "week1_comp_table": lambda t: report.week1_comp_table(t.week1_by_completion),
    "comp_by_level_table": lambda t: report.comp_by_level_table(t.completion_by_week1_level),
    "week1_lift": lambda t: report.week1_lift(t.completion_by_week1_level, t.bands),
    "activation_gap": lambda t: report.activation_gap(t.completion_overall),
    "week1_high_share": lambda t: report.week1_high_share(t.learner_week1, t.bands),
    "mean_course_size": lambda t: report.mean_course_size(t.steps_per_run, t.week1_steps_per_run),
    "dataset_dimensions": lambda t: report.dataset_dimensions(
        t.enrolments_all, t.step_activity_all, t.dup_groups_step_activity
    ),
    "format_summary_table": lambda t: report.format_summary_table(t.engagement_by_completion),
    "format_summary_table_padded": lambda t: report.format_summary_table(t.engagement_by_completion, padded=True),
}
