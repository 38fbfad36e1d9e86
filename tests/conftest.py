import datetime as dt

import pytest
from pyspark.sql import SparkSession

SF_SMALL = "/root/testdata/sf0.001"

ACTIVITY = (
    "course_run string, learner_id string, step string, week_number int, step_number int, "
    "first_visited_at timestamp_ntz, last_completed_at timestamp_ntz"
)
ENROLMENTS = (
    "learner_id string, course_run string, enrolled_at timestamp_ntz, unenrolled_at timestamp_ntz, "
    "fully_participated_at timestamp_ntz, purchased_statement_at timestamp_ntz, gender string, country string, "
    "age_range string, highest_education_level string, employment_status string, employment_area string"
)


@pytest.fixture(scope="session")
def spark():
    # A zone with clock changes: no result may depend on it.
    session = (
        SparkSession.builder.master("local[8]")
        .appName("coursepulse-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "America/New_York")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(n, hour=0):
    """Midnight of the n-th day of a month, plus hours; None stays None."""
    return None if n is None else dt.datetime(2020, 3, n, hour)


@pytest.fixture(scope="session")
def activity(spark):
    """Build activity rows from (learner, step, visited day, completed day[, run[, week]])."""

    def build(rows):
        full = []
        for learner, step, visited, completed, *rest in rows:
            run = rest[0] if rest else "run-1"
            week = rest[1] if len(rest) > 1 else int(step.split(".")[0])
            number = int(step.split(".")[1])
            full.append((run, learner, step, week, number, day(visited), day(completed)))
        df = spark.createDataFrame(full, ACTIVITY)
        return df.withColumn("step_completed", df.last_completed_at.isNotNull())

    return build


@pytest.fixture(scope="session")
def enrolments(spark):
    """Build enrolment rows from (learner, completed day[, run[, demographics]])."""

    def build(rows):
        full = []
        for learner, finished, *rest in rows:
            run = rest[0] if rest else "run-1"
            demographics = rest[1] if len(rest) > 1 else {}
            values = [
                demographics.get(c)
                for c in (
                    "gender", "country", "age_range", "highest_education_level",
                    "employment_status", "employment_area",
                )
            ]
            full.append((learner, run, day(1), None, day(finished), None, *values))
        return spark.createDataFrame(full, ENROLMENTS)

    return build
