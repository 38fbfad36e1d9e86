"""Per-run CSV files and the Parquet store."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursepulse import CourseTables
from coursepulse.model import CSV_TABLES, REPORT_TABLES
from coursepulse.sources import csv_runs, store

STEPS = "learner_id,step,week_number,step_number,first_visited_at,last_completed_at"
PEOPLE = (
    "learner_id,enrolled_at,unenrolled_at,role,fully_participated_at,purchased_statement_at,gender,country,"
    "age_range,highest_education_level,employment_status,employment_area"
)


def write(folder, run, table, text, newline="\n"):
    path = folder / f"course-{run}_{table}.csv"
    path.write_bytes(text.replace("\n", newline).encode())


@pytest.fixture
def folder(tmp_path):
    write(
        tmp_path, 1, "step-activity",
        f"{STEPS}\n"
        "a,3.2,3,2,2017-10-04 09:23:14 UTC,2017-10-04 10:00:00 UTC\n"
        "a,3.20,3,20,2017-10-04 09:23:14 UTC,\n"
        "b,1.1,1,1,junk,\"\"\n",
    )
    write(tmp_path, 3, "step-activity", f"{STEPS}\n")
    write(tmp_path, 9, "step-activity", f"{STEPS}\nz,1.1,1,1,2017-10-04 09:23:14 UTC,\n")
    return tmp_path


def test_missing_empty_and_unrequested_runs(spark, folder):
    df = csv_runs.load_step_activity(spark, str(folder), "course", runs=[1, 2, 3])
    assert {r.course_run for r in df.collect()} == {"course-1"} and df.count() == 3
    assert dict(df.dtypes) == {
        "learner_id": "string", "step": "string", "week_number": "int", "step_number": "int",
        "first_visited_at": "timestamp_ntz", "last_completed_at": "timestamp_ntz",
        "course_run": "string", "step_completed": "boolean",
    }


def test_values(spark, folder):
    rows = {(r.learner_id, r.step): r for r in csv_runs.load_step_activity(spark, str(folder), "course").collect()}
    done = rows["a", "3.2"]
    assert done.first_visited_at == dt.datetime(2017, 10, 4, 9, 23, 14) and done.step_completed
    assert rows["a", "3.20"].last_completed_at is None and not rows["a", "3.20"].step_completed
    assert rows["b", "1.1"].first_visited_at is None


def test_step_as_number_merges(spark, folder):
    as_text = csv_runs.load_step_activity(spark, str(folder), "course")
    as_number = csv_runs.load_step_activity(spark, str(folder), "course", step_as_number=True)
    assert as_text.select("learner_id", "step").distinct().count() == 3
    assert as_number.select("learner_id", "step").distinct().count() == 2


def test_no_files_at_all(spark, tmp_path):
    df = csv_runs.load_enrolments(spark, str(tmp_path), "course")
    assert df.count() == 0
    assert dict(df.dtypes)["enrolled_at"] == "timestamp_ntz" and "course_run" in df.columns


def test_columns_are_matched_by_name(spark, tmp_path):
    write(tmp_path, 1, "step-activity", f"{STEPS}\na,1.1,1,1,2020-01-01 00:00:00 UTC,\n")
    write(
        tmp_path, 2, "step-activity",
        "step,learner_id,extra,step_number,week_number,last_completed_at\n1.2,b,note,2,1,2020-01-02 00:00:00 UTC\n",
    )
    rows = {r.learner_id: r for r in csv_runs.load_step_activity(spark, str(tmp_path), "course").collect()}
    assert (rows["b"].step, rows["b"].week_number, rows["b"].step_number, rows["b"].extra) == ("1.2", 1, 2, "note")
    assert rows["b"].first_visited_at is None and rows["b"].step_completed
    assert (rows["a"].step, rows["a"].extra, rows["a"].course_run) == ("1.1", None, "course-1")


def test_same_headers_share_a_scan(spark, tmp_path):
    for run in (1, 2, 3):
        write(tmp_path, run, "step-activity", f"{STEPS}\na,1.1,1,1,2020-01-01 00:00:00 UTC,\n")
    df = csv_runs.load_step_activity(spark, str(tmp_path), "course")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and len(df.inputFiles()) == 3
    assert sorted(r.course_run for r in df.collect()) == ["course-1", "course-2", "course-3"]


def test_required_columns(spark, tmp_path):
    write(tmp_path, 1, "step-activity", "learner_id,step\na,1.1\n")
    with pytest.raises(ValueError, match="week_number"):
        csv_runs.load_step_activity(spark, str(tmp_path), "course")


def test_line_breaks_in_quoted_text(spark, tmp_path):
    table = "weekly-sentiment-survey-responses"
    write(
        tmp_path, 5, table,
        'id,responded_at,week_number,experience_rating,reason\n'
        '1,2018-04-16 20:17:14 UTC,2,3,"two\nlines, and ""quotes"" — it’s fine"\n2,2018-04-17 20:17:14 UTC,2,1,""\n',
    )
    rows = {r.id: r for r in csv_runs.load_runs(spark, str(tmp_path), table, "course").collect()}
    assert rows[1].reason == 'two\nlines, and "quotes" — it’s fine' and rows[1].experience_rating == 3
    assert rows[2].reason is None and rows[2].course_run == "course-5"


def test_unreadable_lines_are_listed(spark, tmp_path):
    write(
        tmp_path, 1, "step-activity",
        f"{STEPS}\n"
        "a,1.1,1,1,2020-01-01 00:00:00 UTC,2020-01-02 00:00:00 UTC\n"
        "b,1.2,one,2,2020-01-01 00:00:00 UTC,soon\n"
        "c,1.3,1\n"
        "d,1.4,1,4,2020-01-01 00:00:00 UTC,,more,and more\n"
        "e,1.5,NA,,2020-01-01 00:00:00 UTC,NA\n"
        "f,1.6,1.5,99999999999,2020-13-01 00:00:00 UTC,\n",
    )
    # Another run writes its whole numbers with decimals.
    write(tmp_path, 2, "step-activity", f"{STEPS}\ng,2.1,2.0,1.00,2020-01-01 00:00:00 UTC,\n")
    bad = {r.line: (r.course_run, r.problems) for r in csv_runs.rejected(spark, str(tmp_path), "step-activity", "course").collect()}
    assert bad == {
        "b,1.2,one,2,2020-01-01 00:00:00 UTC,soon": ("course-1", ["week_number: one", "last_completed_at: soon"]),
        "c,1.3,1": ("course-1", ["fields"]),
        "d,1.4,1,4,2020-01-01 00:00:00 UTC,,more,and more": ("course-1", ["fields"]),
        "f,1.6,1.5,99999999999,2020-13-01 00:00:00 UTC,": (
            "course-1", ["week_number: 1.5", "step_number: 99999999999", "first_visited_at: 2020-13-01 00:00:00 UTC"],
        ),
    }
    rows = {r.learner_id: r for r in csv_runs.load_step_activity(spark, str(tmp_path), "course").collect()}
    assert len(rows) == 7 and (rows["g"].week_number, rows["g"].step_number) == (2, 1)
    assert (rows["b"].week_number, rows["b"].last_completed_at, rows["b"].step_number) == (None, None, 2)
    assert (rows["c"].week_number, rows["c"].step_number) == (1, None) and rows["d"].step_number == 4
    # Every value that is there as text and NULL in the table belongs to a line in the list.
    assert csv_runs.rejected(spark, str(tmp_path), "step-activity", "course", runs=[2, 3]).count() == 0
    assert csv_runs.rejected(spark, str(tmp_path), "enrolments", "course").count() == 0


def test_unreadable_lines_are_published(spark, tmp_path):
    write(tmp_path, 1, "step-activity", f"{STEPS}\na,1.1,1,1,2020-01-01 00:00:00 UTC,\nb,1.2,x,2,,\n")
    write(tmp_path, 1, "enrolments", f"{PEOPLE}\na,2019-12-01 00:00:00 UTC,,learner,,,male,GB,18-25,U,U,U,too many\n")
    CourseTables.from_csv(spark, str(tmp_path), "course", runs=[1]).publish(str(tmp_path / "s"))
    stored = CourseTables.from_store(spark, str(tmp_path / "s")).rejected_rows
    assert {(r.input, r.problems[0]) for r in stored.collect()} == {("step-activity", "week_number: x"), ("enrolments", "fields")}


def test_crlf_file(spark, tmp_path):
    write(
        tmp_path, 2, "team-members",
        "id,first_name,last_name,team_role,user_role\nt1,FIRST,LAST,host,organisation_admin\n", newline="\r\n",
    )
    (row,) = csv_runs.load_runs(spark, str(tmp_path), "team-members", "course").collect()
    assert (row.id, row.user_role) == ("t1", "organisation_admin")


def test_large_tables_can_be_split():
    assert not CSV_TABLES["step-activity"].multi_line and not CSV_TABLES["enrolments"].multi_line
    assert len(CSV_TABLES["video-stats"].columns) == 28


def test_whole_analysis_from_csv(spark, tmp_path):
    write(
        tmp_path, 1, "step-activity",
        f"{STEPS}\na,1.1,1,1,2020-01-01 00:00:00 UTC,2020-01-02 12:00:00 UTC\n"
        "a,1.1,1,1,2020-01-01 00:00:00 UTC,\nb,1.2,1,2,2020-01-01 00:00:00 UTC,\n",
    )
    write(
        tmp_path, 1, "enrolments",
        f"{PEOPLE}\n"
        "a,2019-12-01 00:00:00 UTC,,learner,2020-02-01 00:00:00 UTC,,Unknown,NA,>65,Unknown,Unknown,Unknown\n"
        "b,2019-12-01 00:00:00 UTC,,learner,,,male,GB,18-25,Unknown,Unknown,Unknown\n"
        "c,2019-12-01 00:00:00 UTC,,learner,,,male,GB,18-25,Unknown,Unknown,Unknown\n",
    )
    t = CourseTables.from_csv(spark, str(tmp_path), "course", runs=[1])
    rows = {r.learner_id: r for r in t.learner_with_week1.collect()}
    assert (rows["a"].completed, rows["a"].completion_percentage, rows["a"].engagement_duration_days) == (True, 50.0, 1.5)
    assert (rows["a"].gender, rows["a"].country, rows["a"].week1_engagement_level) == (None, None, "Medium")
    assert (rows["b"].week1_engagement_level, rows["c"].week1_engagement_level) == ("Very Low", "None")


@pytest.fixture(scope="module")
def star_tables(spark):
    return CourseTables.from_star(spark, "/root/testdata/sf0.001")


def test_publish_and_load(spark, star_tables, tmp_path):
    folder = str(tmp_path / "store")
    before = {n: sorted(map(str, getattr(star_tables, n).select(sorted(getattr(star_tables, n).columns)).collect()))
              for n in ("learner_summary", "completion_overall", "week1_steps_per_run")}
    published = CourseTables.from_star(spark, "/root/testdata/sf0.001").publish(folder)
    loaded = CourseTables.from_store(spark, folder)
    for tables in (published, loaded):
        for name, rows in before.items():
            df = getattr(tables, name)
            assert sorted(map(str, df.select(sorted(df.columns)).collect())) == rows
    assert "lineitem" not in loaded.learner_summary._jdf.queryExecution().optimizedPlan().toString()
    # Asking for one run reads the folder of that run only.
    one = loaded.learner_summary.where("course_run = '2-HIGH'")
    assert "PartitionFilters: [isnotnull(course_run" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 150


def test_co_located_tables_need_no_shuffle_by_learner(spark, star_tables, tmp_path):
    stored = CourseTables.from_star(spark, "/root/testdata/sf0.001").co_locate(str(tmp_path), 4, prefix="test_")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        df = stored.learner_with_week1
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [learner_id" in plan and "Exchange hashpartitioning(learner_id" not in plan
        columns = sorted(df.columns)
        ours = sorted(map(str, df.select(columns).collect()))
    finally:
        spark.conf.set(key, before)
        spark.sql("DROP TABLE test_step_activity_clean")
        spark.sql("DROP TABLE test_enrolments_all")
    assert ours == sorted(map(str, star_tables.learner_with_week1.select(columns).collect()))


def test_store_honours_options(spark, tmp_path):
    folder, star = str(tmp_path / "store"), lambda **o: CourseTables.from_star(spark, "/root/testdata/sf0.001", **o)
    star().publish(folder)
    bands = (("Top", 60), ("Rest", 0))
    sums = lambda t: tuple(t.week1_metrics.selectExpr("count(*)", "sum(week1_steps_visited)").first())
    assert sums(CourseTables.from_store(spark, folder)) == sums(star())
    other = CourseTables.from_store(spark, folder, week=2, bands=bands)
    expected = star(week=2, bands=bands)
    assert sums(other) == sums(expected) != sums(star())
    for name in ("learner_with_week1", "completion_by_week1_level", "week1_summary"):
        ours, theirs = getattr(other, name), getattr(expected, name)
        columns = sorted(ours.columns)
        assert sorted(map(str, ours.select(columns).collect())) == sorted(map(str, theirs.select(columns).collect()))
    star(week=2, bands=bands).publish(folder)
    assert sums(CourseTables.from_store(spark, folder)) == sums(expected)


def test_a_run_has_few_files(spark, tmp_path):
    rows = spark.range(2000).repartition(40).selectExpr("concat('r', id % 3) AS course_run", "id")
    store.publish(rows, str(tmp_path), "t", partitioned=True)
    for run in ("r0", "r1", "r2"):
        assert len(list((tmp_path / "t" / f"course_run={run}").glob("*.parquet"))) <= 2


def test_publish_validates(spark, star_tables, tmp_path):
    broken = star_tables.enrolments_all.withColumn("learner_id", F.nullif("learner_id", F.lit(1)))
    with pytest.raises(ValueError, match="NULL keys"):
        CourseTables(star_tables.step_activity_all, broken).publish(str(tmp_path / "a"))
    moved = star_tables.step_activity_all.withColumn("week_number", (F.col("learner_id") % 3).cast("int"))
    with pytest.raises(ValueError, match="several weeks"):
        CourseTables(moved, star_tables.enrolments_all, step_fixes_week=True).validate()
    CourseTables(moved, star_tables.enrolments_all).validate()


def test_bucketed_tables_open_again(spark, star_tables, tmp_path):
    first = CourseTables.from_star(spark, "/root/testdata/sf0.001")
    expected = sorted(map(str, first.learner_engagement.collect()))
    first.co_locate(str(tmp_path / "a"), 4, prefix="again_")
    try:
        with pytest.raises(ValueError, match="another place"):
            first.co_locate(str(tmp_path / "b"), 4, prefix="again_")
        for name in ("again_step_activity_clean", "again_enrolments_all"):
            spark.sql(f"DROP TABLE {name}")
        opened = CourseTables.from_buckets(spark, str(tmp_path / "a"), "again_")
        assert sorted(map(str, opened.learner_engagement.collect())) == expected
        plan = opened.learner_engagement._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan
    finally:
        for name in ("again_step_activity_clean", "again_enrolments_all"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_runs_are_those_in_the_data(spark, tmp_path):
    """A sixth and a missing order priority: every row stays, and no empty run appears."""
    source, folder = "/root/testdata/sf0.001", str(tmp_path)
    for name in ("nation", "customer", "lineitem"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    orders = spark.read.parquet(f"{source}/orders.parquet")
    other = F.when(F.col("o_orderkey") % 7 == 0, "6-OTHER").when(F.col("o_orderpriority") == "5-LOW", "1-URGENT")
    orders.withColumn("o_orderpriority", F.coalesce(other, "o_orderpriority")).write.parquet(f"{folder}/orders.parquet")
    tables = CourseTables.from_star(spark, folder)
    assert tables.step_activity_all.count() == spark.read.parquet(f"{folder}/lineitem.parquet").count()
    runs = {r[0] for r in tables.enrolments_all.select("course_run").distinct().collect()}
    assert runs == {"1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "6-OTHER"}


def test_queries_over_csv_match_sql(spark, tmp_path):
    """The star tables written as per-run CSV files give every query the same result as SQL on the star tables."""
    from check_oracle import _rows, sql_rows  # noqa: PLC0415
    from coursepulse.plans.queries import QUERIES  # noqa: PLC0415

    star, number = CourseTables.from_star(spark, "/root/testdata/sf0.001"), {}
    for run in sorted(r[0] for r in star.enrolments_all.select("course_run").distinct().collect()):
        number[run] = f"course-{len(number) + 1}"
        for name, df in (("step-activity", star.step_activity_all), ("enrolments", star.enrolments_all)):
            own = df.where(F.col("course_run") == run).drop("course_run", "step_completed")
            stamps = [f.name for f in own.schema if f.dataType == T.TimestampNTZType()]
            own = own.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss 'UTC'") for c in stamps})
            own.toPandas().to_csv(tmp_path / f"{number[run]}_{name}.csv", index=False, na_rep="NA")
    tables = CourseTables.from_csv(spark, str(tmp_path), "course", range(1, 6))
    back = F.create_map(*(F.lit(x) for pair in number.items() for x in pair[::-1]))
    for name in ("completion_overall", "engagement_by_completion", "week1_summary", "completion_by_week1_level",
                 "learner_with_week1", "week1_metrics", "weekly_retention", "engagement_boxplot", "threshold_curve"):
        df = QUERIES[name](tables)
        if "course_run" in df.columns:
            df = df.withColumn("course_run", back[F.col("course_run")])
        if "learner_id" in df.columns:
            df = df.withColumn("learner_id", F.col("learner_id").cast("long"))
        columns, rows = sql_rows("/root/testdata/sf0.001", name)
        assert _rows(df.columns, df.collect()) == _rows(columns, rows), name


def test_run_names_stay_text(spark, tmp_path):
    df = spark.createDataFrame([("007", 1), ("2020-01-01", 2)], "course_run string, n int")
    back = store.publish(df, str(tmp_path), "t", partitioned=True)
    assert back.schema["course_run"].dataType == T.StringType()
    assert {(r.course_run, r.n) for r in back.collect()} == {("007", 1), ("2020-01-01", 2)}


def test_missing_tables_are_listed(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "n int")
    store.publish(df, str(tmp_path), "completion_overall")
    with pytest.raises(ValueError) as error:
        store.require_published(spark, str(tmp_path), REPORT_TABLES)
    assert "learner_summary" in str(error.value) and "completion_overall" not in str(error.value)
