"""Tables and figures of the written report; only here are numbers rounded for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursepulse.functions import count_text, fraction_true, percent_text
from coursepulse.functions.bands import Bands
from coursepulse.model import BANDS
from coursepulse.operators.distributions import level_distribution


def _status():
    return F.when(F.col("completed"), "Completed").otherwise("Did Not Complete")


def enrollment_summary(overall: DataFrame, active: DataFrame) -> DataFrame:
    """Six headline metrics as text, one per row."""
    active_rate = active.agg(fraction_true("completed")).scalar()
    activation = F.when(F.col("n_enrolled") > 0, F.col("n_active") / F.col("n_enrolled"))
    metrics = {
        "Total Enrollments": count_text("n_enrolled"),
        "Active Learners (≥1 step)": count_text("n_active"),
        "Learners Who Completed": count_text("n_completed"),
        "Activation Rate": percent_text(activation * 100),
        "Completion Rate (all enrolled)": percent_text(F.col("completion_rate") * 100),
        "Completion Rate (active only)": percent_text(active_rate * 100),
    }
    wide = overall.select(*(column.alias(name) for name, column in metrics.items()))
    return wide.unpivot([], list(metrics), "metric", "value")


def engagement_table(by_completion: DataFrame) -> DataFrame:
    """Engagement of completers and others, rounded to one decimal."""
    return by_completion.select(
        _status().alias("status"),
        "n",
        F.round("mean_steps_completed", 1).alias("mean_steps"),
        F.round("median_steps_completed", 1).alias("median_steps"),
        F.round("mean_weeks_active", 1).alias("mean_weeks"),
    )


def cycle1_summary(active: DataFrame) -> DataFrame:
    """Steps and weeks of completers and others; means rounded, the median not."""
    return active.groupBy("completed").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("total_steps_completed"), 1).alias("steps_mean"),
        F.median("total_steps_completed").alias("steps_median"),
        F.round(F.avg("num_weeks_active"), 1).alias("weeks_mean"),
    ).select(_status().alias("status"), "n", "steps_mean", "steps_median", "weeks_mean")


def effect_sizes(cycle1: DataFrame) -> DataFrame:
    """How many times more steps and weeks completers have, from the rounded means."""

    def ratio(mean: str):
        of = {s: F.max(F.when(F.col("status") == s, F.col(mean))) for s in ("Completed", "Did Not Complete")}
        return F.round(F.try_divide(of["Completed"], of["Did Not Complete"]), 1)

    return cycle1.agg(ratio("steps_mean").alias("steps_ratio"), ratio("weeks_mean").alias("weeks_ratio"))


def week1_dist_table(learners: DataFrame) -> DataFrame:
    """Learners per band with their share as text."""
    return level_distribution(learners).select(
        "week1_engagement_level", "n", percent_text("percentage").alias("percent_of_all_learners")
    )


def week1_comp_table(by_completion: DataFrame) -> DataFrame:
    """First-week steps and rate of completers and others, rounded to one decimal."""
    return by_completion.select(
        _status().alias("status"),
        "n",
        F.round("mean_week1_steps_completed", 1).alias("mean_week1_steps"),
        F.round("mean_week1_completion_rate", 1).alias("mean_week1_rate"),
    )


def comp_by_level_table(by_level: DataFrame) -> DataFrame:
    """Completion rate per band as text."""
    return by_level.select(
        "week1_engagement_level", "n", percent_text(F.col("completion_rate") * 100).alias("completion_rate")
    )


def _by_floor(bands: Bands) -> list[str]:
    """Labels of the bands, the lowest first."""
    return [label for label, floor in sorted(bands, key=lambda band: band[1])]


def week1_lift(by_level: DataFrame, bands: Bands = BANDS) -> DataFrame:
    """Completion of the highest and the lowest active band, and the ratio of the two."""
    labels = _by_floor(bands)
    lowest, highest = labels[0], labels[-1]

    def rate(level: str):
        return F.max(F.when(F.col("week1_engagement_level") == level, F.col("completion_rate")))

    return by_level.agg(rate(highest).alias("high"), rate(lowest).alias("very_low")).select(
        F.round(F.col("high") * 100, 1).alias("high_percent"),
        F.round(F.col("very_low") * 100, 1).alias("very_low_percent"),
        F.round(F.try_divide("high", "very_low"), 1).alias("lift"),
    )


def activation_gap(overall: DataFrame) -> DataFrame:
    """Percentage of the enrolled who never visit a step."""
    gap = 1 - F.try_divide("n_active", "n_enrolled")
    return overall.select(F.round(gap * 100, 1).alias("activation_gap_percent"))


def week1_high_share(learners: DataFrame, bands: Bands = BANDS) -> DataFrame:
    """Percentage of all learners in the highest band."""
    is_high = F.col("week1_engagement_level") == _by_floor(bands)[-1]
    return learners.agg(F.round(fraction_true(is_high) * 100, 1).alias("high_share_percent"))


def mean_course_size(steps_per_run: DataFrame, week_steps_per_run: DataFrame) -> DataFrame:
    """Mean steps of a run, of its first week, and half of the latter (a chart's guide line)."""
    week = week_steps_per_run.agg(F.round(F.avg("week1_total_steps"))).scalar()
    return steps_per_run.agg(F.round(F.avg("total_steps_in_course")).alias("mean_total_steps")).select(
        "mean_total_steps", week.alias("mean_week1_steps")
    ).withColumn("half_week1_steps", F.col("mean_week1_steps") * 0.5)


def dataset_dimensions(enrolments: DataFrame, activity: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Rows and columns of the two inputs and the number of duplicated keys, one row."""

    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))

    return rows(enrolments, "enrolment_rows").select(
        "enrolment_rows",
        F.lit(len(enrolments.columns)).alias("enrolment_columns"),
        rows(activity, "activity_rows").scalar().alias("activity_rows"),
        F.lit(len(activity.columns)).alias("activity_columns"),
        rows(duplicates, "duplicate_groups").scalar().alias("duplicate_groups"),
    )


def format_summary_table(df: DataFrame, digits: int = 2, padded: bool = False) -> DataFrame:
    """Numeric columns rounded and written with thousands separators; others unchanged.

    All numbers of a column get the decimals that the one with the most needs; ``padded`` also gives them the
    width of the longest, with spaces on the left. What the columns need is found in one pass for all of them.
    """
    numeric = [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]

    def decimals(f: T.StructField) -> range:
        return range(1) if isinstance(f.dataType, T.IntegralType) else range(digits + 1)

    def text(f: T.StructField, places: Column | int) -> Column:
        if isinstance(f.dataType, T.IntegralType):
            return count_text(f.name)
        return F.call_function("format_number", F.round(f.name, digits), F.lit(places))

    def needed(f: T.StructField) -> Column:
        exact = F.round(f.name, digits)
        enough = (F.when(F.round(f.name, d) == exact, d) for d in decimals(f))
        return F.coalesce(F.max(F.coalesce(*enough)), F.lit(0))

    def shape(f: T.StructField) -> Column:
        widths = F.array(*(F.max(F.length(text(f, d))) for d in decimals(f)))
        return F.struct(needed(f).alias("places"), widths.alias("widths")).alias(f.name)

    def shown(f: T.StructField) -> Column:
        if f not in numeric:
            return F.col(f"`{f.name}`")
        own = F.col("_shape").getField(f.name)
        places = own.getField("places")
        written = text(f, places)
        if padded:
            written = F.lpad(written, F.get(own.getField("widths"), places), F.lit(" "))
        return written.alias(f.name)

    if not numeric:
        return df
    shapes = df.agg(F.struct(*map(shape, numeric))).scalar()
    return df.withColumn("_shape", shapes).select(*map(shown, df.schema.fields))
