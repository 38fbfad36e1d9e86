"""Per-run CSV files ``<course>-<run>_<table>.csv`` as one DataFrame over all runs."""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursepulse.functions import parse_utc
from coursepulse.model import CSV_TABLES, CsvTable, require_columns

DEFAULT_RUNS = range(1, 8)
# Column that holds a line whose fields are not as many as the header's.
LINE = "_line"
# Texts read as missing (fixed values).
MISSING = ("", "NA")


def run_names(course: str, runs: Iterable[int | str] = DEFAULT_RUNS) -> list[str]:
    """Values of ``course_run`` for the given run numbers."""
    return [f"{course}-{run}" for run in runs]


def load_runs(
    spark: SparkSession,
    folder: str,
    table: str,
    course: str,
    runs: Iterable[int | str] = DEFAULT_RUNS,
    *,
    step_as_number: bool = False,
    missing: Sequence[str] = MISSING,
) -> DataFrame:
    """Rows of the requested runs that have a file, tagged with ``course_run``.

    Runs without a file are skipped; with none at all the result is empty. Columns are matched
    by header name, so runs may order or omit them differently. Files with the same header are
    read in one scan. ``step`` stays text, as steps 3.2 and 3.20 differ; ``step_as_number``
    reads it as a number and merges such steps.
    """
    spec = CSV_TABLES[table]
    rows = _texts(spark, folder, table, course, runs)
    return _empty(spark, spec) if rows is None else _convert(rows, spec, step_as_number, missing)


def rejected(
    spark: SparkSession,
    folder: str,
    table: str,
    course: str,
    runs: Iterable[int | str] = DEFAULT_RUNS,
    *,
    missing: Sequence[str] = MISSING,
) -> DataFrame:
    """Lines of the requested runs that could not be read whole: course_run, problems, line.

    A problem is a column with a text that its type can't hold, or ``fields`` where a line has more or fewer fields
    than the header. ``load_runs`` has such rows, too, with NULL where a value could not be read; this lists
    them. The line is as in the file if its fields are too many or few, else it is put together from them.
    """
    spec = CSV_TABLES[table]
    rows = _texts(spark, folder, table, course, runs, keep_lines=True)
    if rows is None:
        return spark.createDataFrame([], "course_run string, problems array<string>, line string")
    columns = [c for c in rows.columns if c not in ("course_run", LINE)]

    def problem(name: str) -> Column:
        unread = ~F.col(name).isin(list(missing)) & _typed(F.col(name), spec, name).isNull()
        return F.when(unread, F.concat(F.lit(f"{name}: "), F.col(name)))

    checked = [c for c in columns if c in spec.utc_columns or not isinstance(spec.spark_type(c), T.StringType)]
    problems = F.array(F.when(F.col(LINE).isNotNull(), "fields"), *map(problem, checked))
    line = F.coalesce(LINE, F.concat_ws(",", *(F.coalesce(c, F.lit("")) for c in columns)))
    found = rows.select("course_run", F.array_compact(problems).alias("problems"), line.alias("line"))
    return found.where(F.size("problems") > 0)


def _texts(
    spark: SparkSession, folder: str, table: str, course: str, runs: Iterable[int | str], keep_lines: bool = False
) -> DataFrame | None:
    """All rows of the requested runs as texts, files with the same header in one scan; None if there is none."""
    by_header = defaultdict(list)
    paths = _present_files(spark, folder, table, run_names(course, runs))
    for path, header in _headers(spark, paths).items():
        by_header[header].append(path)
    spec = CSV_TABLES[table]
    scans = [_scan(spark, spec, table, header, paths, keep_lines) for header, paths in by_header.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans) if scans else None


def _present_files(spark: SparkSession, folder: str, table: str, names: list[str]) -> list[str]:
    """Paths of the files that exist, at most one per requested run; no file content is read."""
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*_{table}.csv")
        .load(folder)
        .select("path")
    )
    file_name = F.element_at(F.split("path", "/"), -1)
    wanted = listing.where(file_name.isin([f"{name}_{table}.csv" for name in names]))
    return sorted(row.path for row in wanted.collect())


def _headers(spark: SparkSession, paths: list[str]) -> dict[str, tuple[str, ...]]:
    """Column names of every file that has a first line, read from all files in one job."""
    if not paths:
        return {}
    lines = spark.read.text(paths).select("value", "_metadata.file_name", "_metadata.file_block_start")
    # The rows of a file's first block come in order and from one task.
    first = lines.where("file_block_start = 0").groupBy("file_name").agg(F.first("value").alias("line"))
    by_name = {path.rsplit("/", 1)[-1]: path for path in paths}
    found = {by_name[row.file_name]: row.line.removeprefix("\ufeff") for row in first.collect()}
    return {path: tuple(next(csv.reader([found[path]]))) for path in paths if found.get(path)}


def _scan(
    spark: SparkSession, spec: CsvTable, table: str, header: Sequence[str], paths: list[str], keep_lines: bool
) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    options = {}
    if keep_lines:
        schema = schema.add(LINE, T.StringType())
        # Fields are counted only where all of them are read.
        options = {"columnNameOfCorruptRecord": LINE, "columnPruning": False}
    rows = (
        spark.read.schema(schema)
        .options(
            header=True,
            multiLine=spec.multi_line,
            escape='"',
            ignoreLeadingWhiteSpace=True,
            ignoreTrailingWhiteSpace=True,
            **options,
        )
        .csv(paths)
    )
    run = F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*)_{table}\.csv$", 1)
    return rows.withColumn("course_run", run)


def _typed(text: Column, spec: CsvTable, name: str) -> Column:
    """A text as the type of its column; NULL where it can't be read.

    Runs may write whole numbers with or without decimals that are zero.
    """
    kind = spec.spark_type(name)
    if name in spec.utc_columns:
        return parse_utc(text)
    if isinstance(kind, T.IntegralType):
        number = text.try_cast("decimal(38,6)")
        whole = F.when(number == F.floor(number), number.try_cast(kind))
        return F.coalesce(text.try_cast(kind), whole)
    return text if isinstance(kind, T.StringType) else text.try_cast(kind)


def _convert(
    rows: DataFrame, spec: CsvTable, step_as_number: bool, missing: Sequence[str]
) -> DataFrame:
    """Missing texts become NULL, the others take the types of their columns."""
    columns = {}
    for name in rows.columns:
        if name == "course_run":
            continue
        column = _typed(F.when(~F.col(name).isin(list(missing)), F.col(name)), spec, name)
        if name == "step" and step_as_number:
            column = column.try_cast("double").cast("string")
        columns[name] = column
    return rows.withColumns(columns)


def _empty(spark: SparkSession, spec: CsvTable) -> DataFrame:
    fields = [
        T.StructField(c, T.TimestampNTZType() if c in spec.utc_columns else spec.spark_type(c))
        for c in spec.columns
    ]
    return spark.createDataFrame([], T.StructType([*fields, T.StructField("course_run", T.StringType())]))


def load_step_activity(spark: SparkSession, folder: str, course: str, **options) -> DataFrame:
    """Step activity of all runs with the ``step_completed`` flag."""
    rows = load_runs(spark, folder, "step-activity", course, **options)
    require_columns(rows, CSV_TABLES["step-activity"].required, "step_activity")
    return rows.withColumn("step_completed", F.col("last_completed_at").isNotNull())


def load_enrolments(spark: SparkSession, folder: str, course: str, **options) -> DataFrame:
    """Enrolments of all runs."""
    rows = load_runs(spark, folder, "enrolments", course, **options)
    return require_columns(rows, CSV_TABLES["enrolments"].required, "enrolments")
