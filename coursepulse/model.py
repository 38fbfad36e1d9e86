"""Data model: raw tables, canonical columns, engagement bands and input checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The learner comes first: sorts compare the leading key before the rest, and a run name has
# few distinct values.
STEP_KEYS = ("learner_id", "course_run", "step")
LEARNER_KEYS = ("learner_id", "course_run")

# Raw CSV tables: column -> type. "utc" is a text column holding "yyyy-MM-dd HH:mm:ss UTC".
UTC, STR, INT, LONG, DBL = "utc", "string", "int", "bigint", "double"

# Columns of the enrolment files that describe a learner (fixed values).
DEMOGRAPHICS = (
    "gender",
    "country",
    "age_range",
    "highest_education_level",
    "employment_status",
    "employment_area",
)
UNKNOWN = "Unknown"


@dataclass(frozen=True)
class CsvTable:
    """Column types of one raw table, and whether its text fields may hold line breaks.

    A multi-line file cannot be split and is read by one task, so the flag is set only for
    the table that needs it.
    """

    columns: dict[str, str]
    multi_line: bool = False
    required: tuple[str, ...] = field(default=())

    def spark_type(self, column: str) -> T.DataType:
        kind = self.columns.get(column, STR)
        return T.StringType() if kind == UTC else T.DataType.fromDDL(kind)

    @property
    def utc_columns(self) -> list[str]:
        return [c for c, kind in self.columns.items() if kind == UTC]


# Columns of the per-run files (fixed values).
CSV_TABLES = {
    "step-activity": CsvTable(
        {
            "learner_id": STR,
            "step": STR,
            "week_number": INT,
            "step_number": INT,
            "first_visited_at": UTC,
            "last_completed_at": UTC,
        },
        required=("learner_id", "step", "week_number", "step_number"),
    ),
    "enrolments": CsvTable(
        {
            "learner_id": STR,
            "enrolled_at": UTC,
            "unenrolled_at": UTC,
            "fully_participated_at": UTC,
            "purchased_statement_at": UTC,
            **{c: STR for c in DEMOGRAPHICS},
        },
        required=("learner_id", "enrolled_at", "course_run"),
    ),
    "archetype-survey-responses": CsvTable(
        {"id": LONG, "learner_id": STR, "responded_at": UTC, "archetype": STR}
    ),
    "leaving-survey-responses": CsvTable(
        {
            "id": LONG,
            "learner_id": STR,
            "left_at": UTC,
            "leaving_reason": STR,
            "last_completed_step_at": UTC,
            "last_completed_step": STR,
            "last_completed_week_number": INT,
            "last_completed_step_number": INT,
        }
    ),
    "weekly-sentiment-survey-responses": CsvTable(
        {"id": LONG, "responded_at": UTC, "week_number": INT, "experience_rating": INT, "reason": STR},
        multi_line=True,
    ),
    "team-members": CsvTable(
        {"id": STR, "first_name": STR, "last_name": STR, "team_role": STR, "user_role": STR}
    ),
    "video-stats": CsvTable(
        {
            "step_position": STR,
            "title": STR,
            "video_duration": INT,
            "total_views": INT,
            "total_downloads": INT,
            "total_caption_views": INT,
            "total_transcript_views": INT,
            "viewed_hd": DBL,
            "viewed_five_percent": DBL,
            "viewed_ten_percent": DBL,
            "viewed_twentyfive_percent": DBL,
            "viewed_fifty_percent": DBL,
            "viewed_seventyfive_percent": DBL,
            "viewed_ninetyfive_percent": DBL,
            "viewed_onehundred_percent": DBL,
            "console_device_percentage": DBL,
            "desktop_device_percentage": DBL,
            "mobile_device_percentage": DBL,
            "tv_device_percentage": DBL,
            "tablet_device_percentage": DBL,
            "unknown_device_percentage": DBL,
            "europe_views_percentage": DBL,
            "oceania_views_percentage": DBL,
            "asia_views_percentage": DBL,
            "north_america_views_percentage": DBL,
            "south_america_views_percentage": DBL,
            "africa_views_percentage": DBL,
            "antarctica_views_percentage": DBL,
        }
    ),
}

# Engagement bands: label and the lowest week-1 completion percentage it holds (fixed values).
BANDS = (("High", 75), ("Medium", 40), ("Low", 10), ("Very Low", 0))
NO_BAND = "None"
AT_RISK_BELOW = 40

# Tables a finished run must offer to the report (fixed values).
REPORT_TABLES = (
    "completion_overall",
    "completion_by_week1_level",
    "learner_summary",
    "learner_summary_active",
    "learner_with_week1",
    "learner_with_week1_active",
    "step_activity_clean",
    "steps_per_run",
    "week1_steps_per_run",
    "week1_summary",
    "week1_by_completion",
    "engagement_by_completion",
    "dup_groups_step_activity",
    "enrolments_all",
    "step_activity_all",
)


def require_table(value: object, name: str) -> DataFrame:
    """Fail early when a pipeline input was never built."""
    if not isinstance(value, DataFrame):
        raise TypeError(f"{name} must be a DataFrame, got {type(value).__name__}")
    return value


def require_columns(df: DataFrame, columns: Iterable[str], name: str) -> DataFrame:
    """Return ``df`` unchanged, or raise naming the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks the columns: {', '.join(missing)}")
    return df


def require_names(required: Iterable[str], existing: Iterable[str]) -> None:
    """Raise with the list of required tables that do not exist."""
    existing = set(existing)
    missing = [name for name in required if name not in existing]
    if missing:
        raise ValueError(f"Missing tables: {', '.join(missing)}")


def null_key_counts(df: DataFrame, keys: Sequence[str] = LEARNER_KEYS) -> DataFrame:
    """One row counting NULLs per key column; joins assume all of them are zero."""
    return df.agg(*(F.count_if(F.col(k).isNull()).alias(k) for k in keys))


def require_keys(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Run the NULL-key count and raise if any key column holds a NULL."""
    counts = null_key_counts(df, keys).first().asDict()
    bad = {k: n for k, n in counts.items() if n}
    if bad:
        raise ValueError(f"{name} has NULL keys: {bad}")
    return df


def inconsistent_steps(activity: DataFrame) -> DataFrame:
    """Steps of a run that carry more than one week or step number.

    Empty means a step fixes its week, which allows ``step_fixes_week=True`` in the dedup.
    """
    fields = ("week_number", "step_number")
    varies = [
        (F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1)))) for c in fields
    ]
    return (
        activity.groupBy("course_run", "step")
        .agg(F.coalesce(varies[0] | varies[1], F.lit(False)).alias("varies"))
        .where("varies")
        .drop("varies")
    )
