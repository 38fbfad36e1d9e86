"""All derived tables of a set of course runs, built on demand from two inputs."""

from __future__ import annotations

from collections.abc import Iterable
from copy import copy
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coursepulse.functions.bands import Bands
from coursepulse.model import (
    BANDS,
    CSV_TABLES,
    DEMOGRAPHICS,
    LEARNER_KEYS,
    REPORT_TABLES,
    STEP_KEYS,
    UNKNOWN,
    inconsistent_steps,
    require_columns,
    require_keys,
    require_table,
)
from coursepulse.operators import activity as act
from coursepulse.operators import early, learners, reach
from coursepulse.sources import csv_runs, star, store, versions


def _as_options(stored: dict) -> dict:
    """Options as read back from the store, in the form that ``CourseTables.options`` has."""
    return {**stored, "bands": tuple(map(tuple, stored["bands"]))} if stored else {}


class CourseTables:
    """Derived tables by name; each is a lazy DataFrame, and only those asked for are planned.

    ``step_fixes_week`` states that a step always has the same week and step number (see
    ``operators.activity.clean_step_activity``); ``validate`` checks it.
    """

    # Tables of about the size of an input, stored by run.
    LARGE = (
        "step_activity_all",
        "enrolments_all",
        "dup_groups_step_activity",
        "step_activity_clean",
        "learner_engagement",
        "learner_summary",
        "learner_summary_active",
        "week1_activity",
        "week1_metrics",
        "learner_with_week1",
        "learner_with_week1_active",
        "week_reach",
        "enrolled_reach",
    )
    SMALL = (
        "inactive_summary",
        "steps_per_run",
        "completion_overall",
        "engagement_by_completion",
        "week1_steps_per_run",
        "week1_summary",
        "week1_by_completion",
        "completion_by_week1_level",
    )
    # Written first, each from the ones before it; the inputs are read for their own copies alone.
    BASE = (
        "step_activity_all",
        "enrolments_all",
        "learner_numbers",
        "step_activity_clean",
        "run_sizes",
        "learner_with_week1",
    )
    # Columns that may not be NULL, by input.
    KEYS = {"step_activity_all": STEP_KEYS, "enrolments_all": LEARNER_KEYS}

    def __init__(
        self,
        step_activity: DataFrame,
        enrolments: DataFrame,
        *,
        week: int = 1,
        bands: Bands = BANDS,
        step_fixes_week: bool = False,
    ):
        require_table(step_activity, "step_activity")
        require_table(enrolments, "enrolments")
        require_columns(step_activity, CSV_TABLES["step-activity"].required, "step_activity")
        require_columns(enrolments, CSV_TABLES["enrolments"].required, "enrolments")
        self.step_activity_all = step_activity
        self.enrolments_all = enrolments
        self.week = week
        self.bands = bands
        self.step_fixes_week = step_fixes_week
        # Of published tables: rows, NULL keys and missing demographics of the inputs.
        self.figures: dict = {}
        # Of CSV files: lines that could not be read whole. ``publish`` stores them.
        self.rejected_rows: DataFrame | None = None

    @classmethod
    def from_csv(
        cls,
        spark: SparkSession,
        folder: str,
        course: str,
        runs: Iterable[int | str] = csv_runs.DEFAULT_RUNS,
        **options,
    ) -> CourseTables:
        """Tables over ``<course>-<run>_step-activity.csv`` and ``..._enrolments.csv``."""
        runs = list(runs)
        tables = cls(
            csv_runs.load_step_activity(spark, folder, course, runs=runs),
            csv_runs.load_enrolments(spark, folder, course, runs=runs),
            **options,
        )
        lists = [
            csv_runs.rejected(spark, folder, name, course, runs).withColumn("input", F.lit(name))
            for name in ("step-activity", "enrolments")
        ]
        tables.rejected_rows = lists[0].unionByName(lists[1])
        return tables

    @classmethod
    def from_star(cls, spark: SparkSession, folder: str, **options) -> CourseTables:
        """Tables over the orders star schema, whose steps are built from the week number."""
        options = {"step_fixes_week": True, **options}
        return cls(star.step_activity(spark, folder), star.enrolments(spark, folder), **options)

    @classmethod
    def from_store(cls, spark: SparkSession, folder: str, **options) -> CourseTables:
        """Tables published earlier with ``publish``, with the options they were published with.

        Options that differ are honoured: then only the inputs and the cleaned activity are
        taken from the store, and everything else is derived from these.
        """
        version = versions.current(spark, folder)
        if version is None:
            raise ValueError(f"nothing is published at {folder}")
        return cls._from_version(spark, folder, version, options)

    @classmethod
    def _from_version(
        cls, spark: SparkSession, folder: str, version: versions.Version, options: dict | None = None
    ) -> CourseTables:
        version.require(REPORT_TABLES)
        loaded = {name: versions.load(spark, folder, name, entry) for name, entry in version.entries.items()}
        known = _as_options(version.options)
        tables = cls(loaded.pop("step_activity_all"), loaded.pop("enrolments_all"), **{**known, **(options or {})})
        tables.figures = version.figures
        if tables.options != known:
            vars(tables).update(step_activity_clean=loaded["step_activity_clean"])
            return tables
        tables._serve_learners(loaded["learner_with_week1"])
        vars(tables).update(loaded)
        return tables

    @property
    def options(self) -> dict:
        """What the derived tables depend on besides the inputs."""
        return {"week": self.week, "bands": tuple(map(tuple, self.bands)), "step_fixes_week": self.step_fixes_week}

    def validate(self) -> CourseTables:
        """Check what the joins and the dedup assume: keys are present, a step has one week if so stated.

        Runs two or three aggregations over the inputs. ``publish`` checks the same while it copies them;
        lazy use skips it.
        """
        require_keys(self.step_activity_all, STEP_KEYS, "step_activity")
        require_keys(self.enrolments_all, LEARNER_KEYS, "enrolments")
        return self._require_one_week()

    def _require_one_week(self) -> CourseTables:
        if self.step_fixes_week and not inconsistent_steps(self.step_activity_all).isEmpty():
            raise ValueError("step_activity has steps with several weeks or step numbers; unset step_fixes_week")
        return self

    def _watched(self, name: str, df: DataFrame) -> dict[str, Column]:
        """Figures of an input, taken while its copy is written."""
        if name not in self.KEYS:
            return {}
        figures = {"rows": F.count(F.lit(1))}
        figures |= {f"null_{c}": F.count_if(F.col(c).isNull()) for c in self.KEYS[name]}
        if name == "enrolments_all":
            known = [c for c in DEMOGRAPHICS if c in df.columns]
            figures |= {f"missing_{c}": F.count_if(F.col(c).isNull() | (F.col(c) == UNKNOWN)) for c in known}
        return figures

    def _write(self, writer: versions.Writer, name: str, runs: list[str] | None = None) -> None:
        """Write one table and serve it from there; an input with NULL keys is refused."""
        if name == "learner_numbers":
            df = reach.number_learners(self._learners())
        elif name == "inactive_summary":
            df = reach.never_active(self.enrolled_reach, self.week_reach)
        else:
            df = getattr(self, name)
        large = name in self.LARGE
        replacing = runs if large else None
        written = writer.write(df, name, large, self._watched(name, df), replacing)
        if name in self.KEYS:
            figures = writer.figures[name]
            bad = {c: figures[f"null_{c}"] for c in self.KEYS[name] if figures[f"null_{c}"]}
            if bad:
                raise ValueError(f"{name} has NULL keys: {bad}")
        if runs is not None and large:
            written = written.where(F.col("course_run").isin(runs))
        vars(self)[name] = written
        if name == "step_activity_all":
            self._require_one_week()
        if name == "learner_with_week1":
            self._serve_learners(written)

    def publish(self, folder: str, names: Iterable[str] = (*LARGE, *SMALL)) -> CourseTables:
        """Write the named tables as Parquet, as a new version of the folder, and serve them from there afterwards.

        The inputs are copied first, which is the only time they are read, and checked on the way; the rest is
        derived from the copies, each table from the written ones before it, so nothing expensive is computed
        twice. The version is taken into use at the end, with its options: after a failure the one before
        is served as it was. ``versions.vacuum`` clears what is no longer used.
        """
        writer = versions.Writer(self.enrolments_all.sparkSession, folder)
        # What was planned from the inputs before is planned anew from their copies.
        self._forget()
        for name in dict.fromkeys([*self.BASE, *names]):
            self._write(writer, name)
        if self.rejected_rows is not None:
            self._write(writer, "rejected_rows")
        self.figures = writer.commit(self.options).figures
        return self

    @classmethod
    def add_runs(cls, spark: SparkSession, folder: str, step_activity: DataFrame, enrolments: DataFrame) -> CourseTables:
        """Publish a version with further rows, of new runs or of known ones, and return it.

        Every large table holds its rows by run, so the folders of the runs that the new rows name are
        written anew and all others are taken over. The new activity is merged into the stored clean one by
        its keys. The result is that of publishing all rows together; only the summaries over all runs
        read other runs, from the learner table.
        """
        writer = versions.Writer(spark, folder)
        if writer.base is None:
            raise ValueError(f"nothing is published at {folder}")
        old = cls._from_version(spark, folder, writer.base)
        # The driver sees the names of the new rows' runs.
        named = step_activity.select("course_run").union(enrolments.select("course_run")).distinct().collect()
        runs = sorted(r.course_run for r in named if r.course_run is not None)
        touched = F.col("course_run").isin(runs)

        def with_old(name: str, new: DataFrame) -> DataFrame:
            # Rows without a run stay in, to be refused.
            return getattr(old, name).where(touched).unionByName(new, allowMissingColumns=True)

        part = cls(with_old("step_activity_all", step_activity), with_old("enrolments_all", enrolments), **old.options)
        merged = with_old("step_activity_clean", step_activity).select(part.step_activity_all.columns)
        vars(part)["step_activity_clean"] = act.clean_step_activity(merged, part.step_fixes_week)
        people = step_activity.select("learner_id").union(enrolments.select("learner_id"))
        numbers = reach.number_learners(people, known=old.learner_numbers)
        vars(part)["learner_numbers"] = writer.write(numbers, "learner_numbers", appending=True)
        # What is stored by run, whether in folders or in a few rows, comes from the runs touched.
        for name in dict.fromkeys([*cls.BASE, *(n for n in cls.LARGE if n in writer.base.entries)]):
            if name in cls.LARGE:
                part._write(writer, name, runs)
            elif name not in writer.entries:
                kept = getattr(old, name).where(~touched)
                vars(part)[name] = store.checkpointed(getattr(part, name))
                writer.write(kept.unionByName(vars(part)[name]), name)
        if old.rejected_rows is not None:
            writer.keep("rejected_rows")
        whole = cls._from_entries(spark, folder, writer, old.options)
        for name in (n for n in writer.base.entries if n not in writer.entries):
            whole._write(writer, name)
        return cls._from_version(spark, folder, writer.commit(old.options))

    @classmethod
    def _from_entries(cls, spark: SparkSession, folder: str, writer: versions.Writer, options: dict) -> CourseTables:
        """The tables that a writer has so far, over all runs."""
        loaded = {name: versions.load(spark, folder, name, entry) for name, entry in writer.entries.items()}
        tables = cls(loaded.pop("step_activity_all"), loaded.pop("enrolments_all"), **options)
        tables._serve_learners(loaded["learner_with_week1"])
        vars(tables).update(loaded)
        return tables

    def _serve_learners(self, stored: DataFrame) -> None:
        """Take the other forms of the learner table from its stored one."""
        summary = [c for c in stored.columns if not c.startswith("week1_")]
        vars(self)["learner_summary"] = stored.select(*summary)
        vars(self)["learner_week1"] = stored

    def co_locate(self, folder: str, buckets: int, prefix: str) -> CourseTables:
        """Store cleaned activity and enrolments bucketed by learner and serve them from there.

        For repeated analyses (other weeks, other bands): the shuffles by learner are paid once
        here, and every learner table derived afterwards reads its buckets in place. Returns
        new ``CourseTables``; the names of the stored tables start with ``prefix``, one for each
        course, and ``from_buckets`` opens them in a later session.
        """
        clean, people = (
            store.save_bucketed(df, folder, f"{prefix}{name}", buckets)
            for name, df in (
                ("step_activity_clean", self.step_activity_clean),
                ("enrolments_all", self.enrolments_all),
            )
        )
        return self._with_inputs(clean, people)

    @classmethod
    def from_buckets(cls, spark: SparkSession, folder: str, prefix: str, **options) -> CourseTables:
        """Tables over activity and enrolments stored by ``co_locate``; the stored activity is clean already."""
        clean = store.open_bucketed(spark, folder, f"{prefix}step_activity_clean")
        people = store.open_bucketed(spark, folder, f"{prefix}enrolments_all")
        return cls(clean, people, **options)._with_inputs(clean, people)

    def _forget(self) -> None:
        """Drop the derived tables planned so far."""
        for name in list(vars(self)):
            if isinstance(getattr(type(self), name, None), cached_property):
                del vars(self)[name]

    def _with_inputs(self, clean: DataFrame, enrolments: DataFrame) -> CourseTables:
        """The same course over an activity table that is already clean."""
        tables = copy(self)
        tables._forget()
        vars(tables).update(step_activity_clean=clean, enrolments_all=enrolments)
        return tables

    # Activity

    @cached_property
    def step_activity_clean(self) -> DataFrame:
        return act.clean_step_activity(self.step_activity_all, self.step_fixes_week)

    @cached_property
    def dup_groups_step_activity(self) -> DataFrame:
        return act.duplicate_groups(self.step_activity_all)

    @cached_property
    def inactive_summary(self) -> DataFrame:
        return act.never_active(self.enrolments_all, self.step_activity_all)

    def _learners(self) -> DataFrame:
        return self.enrolments_all.select("learner_id").union(self.step_activity_all.select("learner_id"))

    @cached_property
    def learner_numbers(self) -> DataFrame:
        """A number for every learner; computed at once, as every computation deals out others."""
        return store.checkpointed(reach.number_learners(self._learners()))

    @cached_property
    def week_reach(self) -> DataFrame:
        """Learners of each week of a run as bitmaps, which merge over runs."""
        return reach.reach(self.step_activity_clean, self.learner_numbers, ("course_run", "week_number"))

    @cached_property
    def enrolled_reach(self) -> DataFrame:
        return reach.reach(self.enrolments_all, self.learner_numbers, ("course_run",))

    @cached_property
    def steps_per_run(self) -> DataFrame:
        return act.count_steps(self.step_activity_clean)

    @cached_property
    def week1_activity(self) -> DataFrame:
        return act.activity_in_week(self.step_activity_clean, self.week)

    @cached_property
    def week1_steps_per_run(self) -> DataFrame:
        return act.count_steps(self.week1_activity, "week1_total_steps")

    @cached_property
    def run_sizes(self) -> DataFrame:
        return act.run_sizes(self.step_activity_clean, self.week)

    # Learners

    @cached_property
    def learner_engagement(self) -> DataFrame:
        return learners.learner_engagement(self.step_activity_clean)

    @cached_property
    def learner_summary(self) -> DataFrame:
        return learners.learner_summary(
            self.enrolments_all, self.learner_engagement, self.steps_per_run
        )

    @cached_property
    def learner_summary_active(self) -> DataFrame:
        return learners.active_learners(self.learner_summary)

    @cached_property
    def completion_overall(self) -> DataFrame:
        return learners.completion_overall(self.learner_summary)

    @cached_property
    def engagement_by_completion(self) -> DataFrame:
        return learners.engagement_by_completion(self.learner_summary_active)

    # First week

    @cached_property
    def week1_metrics(self) -> DataFrame:
        return early.week1_metrics(
            self.week1_activity, self.week1_steps_per_run, self.week, self.bands
        )

    @cached_property
    def learner_with_week1(self) -> DataFrame:
        return early.learner_with_week1(
            self.enrolments_all,
            self.step_activity_clean,
            self.run_sizes,
            self.week,
            self.bands,
        )

    @cached_property
    def learner_with_week1_active(self) -> DataFrame:
        return early.week1_active_learners(self.learner_with_week1)

    @cached_property
    def learner_week1(self) -> DataFrame:
        """The table ``learner_with_week1`` for queries that read only first-week columns.

        It is put together from the separate tables, so Catalyst drops the joins to the
        whole-course ones when no column of theirs is read, and only one week is scanned.
        """
        return early.attach_week1(self.learner_summary, self.week1_metrics, self.bands)

    @cached_property
    def learner_week1_active(self) -> DataFrame:
        return early.week1_active_learners(self.learner_week1)

    @cached_property
    def week1_summary(self) -> DataFrame:
        return early.week1_summary(self.learner_week1)

    @cached_property
    def week1_by_completion(self) -> DataFrame:
        return early.week1_by_completion(self.learner_week1_active)

    @cached_property
    def completion_by_week1_level(self) -> DataFrame:
        return early.completion_by_level(self.learner_week1_active)
