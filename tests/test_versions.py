"""Versioned publishing: all or nothing, inputs read once, further runs without rewriting the others."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from coursepulse import CourseTables
from coursepulse.model import DEMOGRAPHICS
from coursepulse.operators import distributions, reach
from coursepulse.sources import store, versions

RUNS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
ALL = (*CourseTables.LARGE, *CourseTables.SMALL, "run_sizes")
SOME = ("step_activity_all", "learner_summary", "week1_metrics", "completion_overall", "steps_per_run")


@pytest.fixture(scope="module")
def star(spark):
    """The star course over inputs that are kept, so that plans stay short."""
    t = CourseTables.from_star(spark, SF_SMALL)
    return CourseTables(*map(store.checkpointed, (t.step_activity_all, t.enrolments_all)), step_fixes_week=True)


def course(star, keep, **options):
    """The course over the rows of both inputs that a condition keeps."""
    return CourseTables(
        star.step_activity_all.where(keep), star.enrolments_all.where(keep), **{"step_fixes_week": True, **options}
    )


def rows(df):
    """Rows in order; means have their last digits from the order of the sums."""
    plain = ([f"{v:.9g}" if isinstance(v, float) else str(v) for v in r] for r in df.select(sorted(df.columns)).collect())
    return sorted(plain)


def same_tables(ours, theirs, names=ALL):
    for name in names:
        if name.endswith("_reach"):  # learners' numbers differ, what they count doesn't
            keys = [c for c in getattr(ours, name).columns if c not in ("bucket", "learners")]
            counted = (reach.distinct_learners(getattr(t, name), keys, "n") for t in (ours, theirs))
            assert rows(next(counted)) == rows(next(counted)), name
            continue
        a, b = getattr(ours, name), getattr(theirs, name)
        assert dict(a.dtypes) == dict(b.dtypes), name
        assert rows(a) == rows(b), name


def folders(version):
    return {name: set(e.paths) for name, e in version.entries.items()}


def test_a_failure_leaves_the_version_before(spark, star, tmp_path, monkeypatch):
    folder, first = str(tmp_path / "s"), F.col("course_run") == RUNS[0]
    course(star, first).publish(folder)
    before = {n: rows(getattr(CourseTables.from_store(spark, folder), n)) for n in SOME}
    write, done = versions.Writer.write, []

    def fails(self, df, name, *args, **kwargs):
        if len(done) == 6:
            raise OSError("the disk is full")
        done.append(name)
        return write(self, df, name, *args, **kwargs)

    other = course(star, F.lit(True), week=2, bands=(("Top", 60), ("Rest", 0)))
    monkeypatch.setattr(versions.Writer, "write", fails)
    with pytest.raises(OSError, match="disk is full"):
        other.publish(folder)
    monkeypatch.setattr(versions.Writer, "write", write)
    loaded = CourseTables.from_store(spark, folder)
    assert loaded.options == course(star, first).options
    assert {n: rows(getattr(loaded, n)) for n in SOME} == before
    # The leavings are cleared, and the version in use stays whole.
    leavings = versions.vacuum(spark, folder)
    assert len(leavings) == 6 and {p.split("/")[0] for p in leavings} == set(done)
    assert {n: rows(getattr(CourseTables.from_store(spark, folder), n)) for n in SOME} == before


def test_versions_follow_each_other(spark, star, tmp_path):
    folder = str(tmp_path / "s")
    with pytest.raises(ValueError, match="nothing is published"):
        CourseTables.from_store(spark, folder)
    assert versions.vacuum(spark, folder) == []
    for n, run in enumerate(RUNS[:3], 1):
        course(star, F.col("course_run") == run).publish(folder)
        assert versions.current(spark, folder).number == n
    runs = {r.course_run for r in CourseTables.from_store(spark, folder).learner_summary.collect()}
    assert runs == {RUNS[2]}
    assert versions.read(spark, folder, 1).options["week"] == 1
    assert versions.vacuum(spark, folder, keep=1)
    with pytest.raises(ValueError, match="no version 1"):
        versions.read(spark, folder, 1)
    same_tables(CourseTables.from_store(spark, folder), course(star, F.col("course_run") == RUNS[2]), SOME)


def test_of_two_writers_the_second_fails(spark, tmp_path):
    folder = str(tmp_path / "s")
    a, b = versions.Writer(spark, folder), versions.Writer(spark, folder)
    for writer in (a, b):
        writer.write(spark.range(3).toDF("n"), "t")
    a.commit({"by": "a"})
    with pytest.raises(Exception, match="already exists"):
        b.commit({"by": "b"})
    assert versions.current(spark, folder).options == {"by": "a"}


def test_adding_a_run_equals_publishing_all(spark, star, tmp_path):
    folder, whole = str(tmp_path / "a"), str(tmp_path / "b")
    new = F.col("course_run") == RUNS[4]
    course(star, ~new).publish(folder)
    before = folders(versions.current(spark, folder))
    added = CourseTables.add_runs(spark, folder, star.step_activity_all.where(new), star.enrolments_all.where(new))
    course(star, F.lit(True)).publish(whole)
    expected = CourseTables.from_store(spark, whole)
    same_tables(added, expected)
    pooled = distributions.weekly_retention(expected.step_activity_clean)
    assert rows(reach.weekly_retention(added.week_reach)) == rows(pooled)
    numbers = added.learner_numbers
    assert numbers.count() == numbers.select("number").distinct().count() == numbers.select("learner_id").distinct().count()
    after = folders(versions.current(spark, folder))
    assert before["learner_numbers"] < after["learner_numbers"]
    for name in CourseTables.LARGE:
        assert before[name] < after[name], name
        assert [p.rsplit("/", 1)[1] for p in after[name] - before[name]] == [f"course_run={RUNS[4]}"], name


def test_further_rows_of_a_known_run_are_merged(spark, star, tmp_path):
    """Activity and enrolments of one run come in two parts that overlap in their steps."""
    folder = str(tmp_path / "s")
    late = (F.col("course_run") == RUNS[1]) & (F.xxhash64("learner_id", "first_visited_at") % 3 == 0)
    joined_late = (F.col("course_run") == RUNS[1]) & (F.col("learner_id") % 4 == 0)
    activity, people = star.step_activity_all, star.enrolments_all
    CourseTables(activity.where(~late), people.where(~joined_late), step_fixes_week=True).publish(folder)
    before = folders(versions.current(spark, folder))
    added = CourseTables.add_runs(spark, folder, activity.where(late), people.where(joined_late))
    same_tables(added, course(star, F.lit(True)))
    after = folders(versions.current(spark, folder))
    for name in CourseTables.LARGE:
        changed = before[name] ^ after[name]
        assert len(changed) == 2 and all(p.endswith("course_run=2-HIGH") for p in changed), name


def test_adding_under_other_options_and_twice(spark, star, tmp_path):
    folder, options = str(tmp_path / "s"), {"week": 2, "bands": (("Top", 60), ("Rest", 0))}
    first, second, third = (F.col("course_run") == r for r in RUNS[:3])
    course(star, first, **options).publish(folder)
    for new in (second, third):
        CourseTables.add_runs(spark, folder, star.step_activity_all.where(new), star.enrolments_all.where(new))
    expected = course(star, first | second | third, **options)
    loaded = CourseTables.from_store(spark, folder)
    assert loaded.options == expected.options and versions.current(spark, folder).number == 3
    same_tables(loaded, expected)


def test_refused_rows_change_nothing(spark, star, tmp_path):
    folder = str(tmp_path / "s")
    new = F.col("course_run") == RUNS[4]
    course(star, ~new).publish(folder)
    nobody = star.enrolments_all.where(new).withColumn("learner_id", F.nullif("learner_id", F.lit(1)))
    with pytest.raises(ValueError, match="NULL keys: {'learner_id': 1}"):
        CourseTables.add_runs(spark, folder, star.step_activity_all.where(new), nobody)
    no_run = star.step_activity_all.where(new).withColumn("course_run", F.lit(None).cast("string"))
    with pytest.raises(ValueError, match="NULL keys"):
        CourseTables.add_runs(spark, folder, no_run, star.enrolments_all.where(new))
    moved = star.step_activity_all.where(new).withColumn("week_number", (F.col("learner_id") % 3).cast("int"))
    with pytest.raises(ValueError, match="several weeks"):
        CourseTables.add_runs(spark, folder, moved, star.enrolments_all.where(new))
    assert versions.current(spark, folder).number == 1
    same_tables(CourseTables.from_store(spark, folder), course(star, ~new), ("learner_summary", "completion_overall"))


def test_publish_reads_the_inputs_once(spark, star, tmp_path):
    counts = {}

    def counted(df, name):
        seen = counts[name] = spark.sparkContext.accumulator(0)

        @F.udf("string")
        def passing(run):
            seen.add(1)
            return run

        return spark.createDataFrame(df.collect(), df.schema).withColumn("course_run", passing("course_run"))

    inputs = {"step_activity_all": star.step_activity_all, "enrolments_all": star.enrolments_all}
    t = CourseTables(*(counted(df, name) for name, df in inputs.items()), step_fixes_week=True)
    t.completion_overall  # planned before, and planned anew by publish
    t.publish(str(tmp_path / "s"))
    n = {name: df.count() for name, df in inputs.items()}
    assert {name: acc.value for name, acc in counts.items()} == n
    figures = CourseTables.from_store(spark, str(tmp_path / "s")).figures
    assert figures["step_activity_all"] == {"rows": 6000, "null_learner_id": 0, "null_course_run": 0, "null_step": 0}
    people = figures["enrolments_all"]
    missing = star.learner_summary.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in DEMOGRAPHICS)).first()
    assert people["rows"] == 750 and {c: people[f"missing_{c}"] for c in DEMOGRAPHICS} == missing.asDict()


def test_empty_inputs(spark, star, tmp_path):
    folder = str(tmp_path / "s")
    course(star, F.lit(False)).publish(folder)
    empty = CourseTables.from_store(spark, folder)
    same_tables(empty, course(star, F.lit(False)))
    some = F.col("course_run") == RUNS[0]
    CourseTables.add_runs(spark, folder, star.step_activity_all.where(some), star.enrolments_all.where(some))
    CourseTables.add_runs(spark, folder, star.step_activity_all.limit(0), star.enrolments_all.limit(0))
    same_tables(CourseTables.from_store(spark, folder), course(star, some))


def test_run_names_that_need_escaping(spark, star, tmp_path):
    folder = str(tmp_path / "s")
    odd = F.concat(F.lit("a/b=c %:"), F.col("course_run"))
    activity = star.step_activity_all.withColumn("course_run", odd)
    people = star.enrolments_all.withColumn("course_run", odd)
    new = F.col("course_run").endswith("5-LOW")
    CourseTables(activity.where(~new), people.where(~new)).publish(folder)
    for _ in range(2):
        added = CourseTables.add_runs(spark, folder, activity.where(new), people.where(new).limit(0))
    assert added.learner_engagement.count() == star.learner_engagement.count()
    assert {r.course_run for r in added.steps_per_run.collect()} == {f"a/b=c %:{r}" for r in RUNS}


def test_bitmaps_count_exactly(spark):
    """Learners by name, over many buckets, some in several groups, some without a name or a week."""
    people = spark.range(150_000).repartition(7).select(
        F.concat(F.lit("p"), F.col("id") % 90_000).alias("learner_id"),
        F.concat(F.lit("r"), F.col("id") % 3).alias("course_run"),
        F.nullif((F.col("id") % 5).cast("int"), F.lit(4)).alias("week_number"),
    )
    people = people.withColumn("learner_id", F.nullif("learner_id", F.lit("p17")))
    half = people.where("course_run <> 'r2'")
    numbers = store.checkpointed(reach.number_learners(half))
    more = store.checkpointed(reach.number_learners(people, known=numbers))
    assert more.join(numbers, "number").count() == 0 and more.join(numbers, "learner_id").count() == 0
    numbers = numbers.unionAll(more)
    old = reach.reach(half, numbers, ("course_run", "week_number"))
    new = reach.reach(people.where("course_run = 'r2'"), numbers, ("course_run", "week_number"))
    merged = old.unionAll(new)
    for keys in ([], ["course_run"], ["week_number"], ["course_run", "week_number"]):
        expected = people.groupBy(*keys).agg(F.count_distinct("learner_id").alias("n"))
        assert rows(reach.distinct_learners(merged, keys, "n")) == rows(expected)
    assert reach.distinct_learners(merged.limit(0), [], "n").first().n == 0
