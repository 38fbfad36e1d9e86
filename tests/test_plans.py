"""What the plans may and may not contain, and facts that hold on the test tables."""

import re

import pytest
from pyspark.sql import functions as F
from conftest import SF_SMALL

from coursepulse import CourseTables
from coursepulse.operators import distributions, early, histogram, joins
from coursepulse.plans.queries import QUERIES


@pytest.fixture(scope="module")
def tables(spark):
    return CourseTables.from_star(spark, SF_SMALL)


@pytest.fixture
def no_auto_broadcast(spark):
    """As with tables too large to broadcast: only hinted broadcasts remain."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_scale(spark, no_auto_broadcast, name):
    plan = plan_of(QUERIES[name](CourseTables.from_star(spark, SF_SMALL)))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Arrow", "MapInPandas"):
        assert bad not in plan
    # Windows only run within groups.
    assert not re.search(r"Window \[[^\]]*windowspecdefinition\([^\]]*\], \[\], ", plan)
    # No exact percentile over values with unbounded distinct counts.
    assert "percentile(value" not in plan
    # Broadcasts: tables of one row per run, or the six groups of the box plot.
    for key in re.findall(r"BroadcastHashJoin \[(.*?)\], ", plan):
        assert re.sub(r"#\d+L?", "", key) in ("course_run", "metric, completed", "metric, completed, subrange")


def test_learner_table_shuffles(tables, no_auto_broadcast):
    """Activity: its own join, the dedup, distinct weeks, learners. Nothing for joining features."""
    plan = plan_of(tables.learner_with_week1)
    assert plan.count("SortAggregate") == 2  # one dedup, combined before and merged after its shuffle
    by_learner = re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, (\w+)#\d+L?, \d+\), ENSURE", plan)
    by_learner = [pair for pair in by_learner if pair[0] in ("learner_id", "o_custkey")]
    # Enrolled people, their dates, and the features: one each, none repeated for the joins.
    assert len(by_learner) == 3


def test_week_filter_reaches_the_scan(tables):
    plan = plan_of(tables.week1_activity)
    assert re.search(r"DataFilters: \[[^\]]*l_suppkey[^\]]*% 3\) \+ 1\)[^\]]*= 1\)", plan)


def test_key_queries_skip_the_dedup(tables):
    for df in (tables.steps_per_run, distributions.weekly_retention(tables.step_activity_clean), tables.run_sizes):
        plan = plan_of(df)
        assert "SortAggregate" not in plan and "l_returnflag" not in plan and "l_shipdate" not in plan


def line_scans(df):
    """Columns of each scan of the activity source."""
    return re.findall(r"FileScan parquet \[(l_orderkey[^\]]*)\]", plan_of(df))


def test_unused_course_sizes_are_not_computed(tables):
    assert len(line_scans(tables.learner_summary)) == 2
    # No step total is needed here, so its join and its scan go away.
    assert len(line_scans(tables.completion_overall)) == 1
    assert len(line_scans(tables.engagement_by_completion)) == 1


@pytest.mark.parametrize("name", ["threshold_curve", "completion_by_week1_level", "at_risk_learners"])
def test_first_week_queries_scan_one_week(tables, name):
    plan = plan_of(QUERIES[name](tables))
    scans = line_scans(QUERIES[name](tables))
    # One scan for the activity, one of fewer columns for the size of the week.
    assert sorted("l_returnflag" in scan for scan in scans) == [False, True]
    filters = re.findall(r"FileScan parquet \[l_orderkey.*?DataFilters: \[(.*?), Format", plan)
    assert len(filters) == len(scans) and all("% 3" in f for f in filters)
    assert "count(distinct" not in plan


def test_trend_needs_no_course_size(tables):
    points = early.completion_by_week1_steps(tables.learner_week1_active)
    assert len(line_scans(points)) == 1 and "l_returnflag" in line_scans(points)[0]
    # The points are computed once and kept; the fits read them from there.
    assert line_scans(QUERIES["week1_steps_trend"](tables)) == []


def test_histogram_counts_once(spark, tables):
    active = tables.learner_summary_active
    df = histogram.histogram(active, "total_steps_completed", ["completed"], 50, few_values=True)
    df.collect()
    assert "ReusedExchange" in plan_of(df)


def test_histogram_of_continuous_values_shuffles_bins(tables):
    df = QUERIES["duration_histogram"](tables)
    df.collect()
    plan = plan_of(df)
    dealt = [re.sub(r"#\d+L?", "", x) for x in re.findall(r"hashpartitioning\((.*?), \d+\)", plan)]
    assert any(x.startswith("completed, bin, ") for x in dealt) and not any("value" in x for x in dealt)
    assert "ReusedExchange" in plan  # the bins and the list of groups come from one count


def test_runs_are_joined_by_measured_size(spark, tables):
    """A few runs are broadcast at run time, and a hot run is split where they are not."""
    people = spark.range(40_000).select(
        F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("run"), F.col("id") % 50)).alias("course_run"),
        F.sha2(F.col("id").cast("string"), 512).alias("learner_id"),
    )
    per_run = people.groupBy("course_run").agg(F.count(F.lit(1)).alias("n"))
    options = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128k",
    }
    before = {k: spark.conf.get(k, None) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        joined = joins.join_per_run(people.repartition(8), per_run)
        joined.collect()
        assert "skew=true" in plan_of(joined)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
        joined = joins.join_per_run(people.repartition(8), per_run)
        joined.collect()
        assert "BroadcastHashJoin [course_run" in plan_of(joined)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_weeks_are_counted_without_a_shuffle_by_week(tables):
    for df in (tables.learner_engagement, tables.learner_with_week1):
        df.collect()
        keys = [set(re.findall(r"(\w+)#", found)) for found in re.findall(r"hashpartitioning\((.*?), \d+\)", plan_of(df))]
        assert {"learner_id", "course_run"} in keys
        assert {"learner_id", "course_run", "week_number"} not in keys


def test_invariants(tables):
    enrolled = tables.enrolments_all.count()
    assert tables.learner_summary.count() == tables.learner_with_week1.count() == enrolled
    overall = tables.completion_overall.first()
    assert overall.n_enrolled >= overall.n_active >= 0
    clean = tables.step_activity_clean
    assert clean.count() == clean.select("learner_id", "course_run", "step").distinct().count()
    assert tables.learner_with_week1.where("week1_steps_visited > 0 AND total_steps_visited = 0").count() == 0
    shares = distributions.level_distribution(tables.learner_with_week1).agg({"percentage": "sum"}).first()[0]
    assert shares == pytest.approx(100)
    counted = histogram.histogram(tables.learner_summary_active, "total_steps_completed", ["completed"], 50)
    assert counted.agg({"n": "sum"}).first()[0] == tables.learner_summary_active.count()
