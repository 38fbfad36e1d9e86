"""Time the headline queries; prints one JSON line.

Each query is run twice from the files and the shorter time counts, so that code generation
and JIT warm-up, which do not grow with the data, weigh less.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_QUERIES (comma-separated
names, or "all").
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from coursepulse import CourseTables
from coursepulse.plans.queries import QUERIES

HEADLINE = (
    "step_activity_clean",
    "step_activity_clean_any_week",
    "dup_groups_step_activity",
    "steps_per_run",
    "learner_engagement",
    "learner_summary",
    "completion_overall",
    "engagement_by_completion",
    "completion_by_demographic_age_range",
    "week1_metrics",
    "learner_with_week1",
    "learner_with_week1_any_week",
    "completion_by_week1_level",
    "weekly_retention",
    "week1_level_distribution",
    "completion_funnel",
    "steps_histogram",
    "engagement_boxplot",
    "threshold_curve",
    "week1_steps_trend",
    "at_risk_learners",
    "week1_lift",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("coursepulse-bench")
        .config("spark.sql.shuffle.partitions", cores)
        # Orders do not fit a broadcast at the sizes this is built for; time that plan.
        .config("spark.sql.autoBroadcastJoinThreshold", "1MB")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](CourseTables.from_star(spark, folder)).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run(names[0])  # start the engine and compile once
    times = {name: min(run(name), run(name)) for name in names}
    total = round(sum(times.values()), 3)
    sf = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cores": int(cores),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
