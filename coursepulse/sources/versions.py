"""Versions of a set of tables in one folder: written apart, then taken into use all at once.

``<folder>/<table>/v=<version>-<token>/`` holds what a version wrote of a table, large tables by course run, and
``<folder>/manifest/version=<n>/`` names the folders that make up version n, with schemas, options and figures. The
manifest is one small file, written last: until it is there, readers see the version before, whole. A
version may take over folders of earlier ones, so adding a run writes the folders of that run alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursepulse.model import require_names

MANIFEST = "manifest"
RUN = "course_run"
#: The column that the folder of a version would become; dropped on reading.
VERSION_COLUMN = "v"
_ENTRIES = "name string, schema string, partitioned boolean, paths array<string>, options string, figures string"


@dataclass(frozen=True)
class Entry:
    """A table of a version: schema, and its folders relative to the store's."""

    schema: str
    partitioned: bool
    paths: tuple[str, ...]


@dataclass(frozen=True)
class Version:
    """What a manifest says."""

    number: int
    entries: dict[str, Entry]
    options: dict
    figures: dict

    def require(self, names: Iterable[str]) -> None:
        """Raise, listing the missing ones, unless the version has every named table."""
        require_names(names, self.entries)


def _rows(spark: SparkSession, folder: str) -> DataFrame | None:
    schema = T.StructType.fromDDL(_ENTRIES).add("version", "long")
    try:
        return spark.read.schema(schema).parquet(f"{folder}/{MANIFEST}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def current(spark: SparkSession, folder: str) -> Version | None:
    """The newest version with a manifest; None if there is none."""
    rows = _rows(spark, folder)
    newest = rows.agg(F.max("version")).first()[0] if rows is not None else None
    return None if newest is None else read(spark, folder, newest)


def read(spark: SparkSession, folder: str, number: int) -> Version:
    """A version by number, as long as its folders are kept."""
    rows = _rows(spark, folder)
    found = rows.where(F.col("version") == number).collect() if rows is not None else []
    if not found:
        raise ValueError(f"{folder} has no version {number}")
    entries = {r.name: Entry(r.schema, r.partitioned, tuple(r.paths)) for r in found}
    return Version(number, entries, json.loads(found[0].options), json.loads(found[0].figures))


def load(spark: SparkSession, folder: str, name: str, entry: Entry) -> DataFrame:
    """A table of a version. Filters on the run choose folders; run names stay text."""
    schema = T.StructType.fromJson(json.loads(entry.schema))
    if not entry.paths:
        return spark.createDataFrame([], schema)
    stored = T.StructType([*schema.fields, T.StructField(VERSION_COLUMN, T.StringType())])
    reader = spark.read.schema(stored).option("basePath", f"{folder}/{name}")
    return reader.parquet(*(f"{folder}/{path}" for path in entry.paths)).select(schema.fieldNames())


class Writer:
    """Writes the tables of a new version; nothing is visible before ``commit``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.base = current(spark, folder)
        self.number = (self.base.number if self.base else 0) + 1
        self._mark = f"{VERSION_COLUMN}={self.number}-{uuid.uuid4().hex[:8]}"
        self.entries: dict[str, Entry] = {}
        self.figures: dict = {}

    def write(
        self,
        df: DataFrame,
        name: str,
        partitioned: bool = False,
        observe: dict[str, F.Column] | None = None,
        replacing: Iterable[str] | None = None,
        appending: bool = False,
    ) -> DataFrame:
        """Write a table and return it as read back.

        observe: figures (aggregates) taken while the rows pass by; they end up in ``figures``. replacing: of a
        table by run, the runs that df has all rows of; the folders of other runs are taken over. appending: all
        rows of the version before stay.
        """
        path = f"{name}/{self._mark}"
        observation = None
        if observe:
            observation = Observation()
            df = df.observe(observation, *(column.alias(key) for key, column in observe.items()))
        if partitioned:
            # Rows of a run come together, a large run in several parts: few files, no hot task.
            df.hint("rebalance", RUN).write.partitionBy(RUN).parquet(f"{self.folder}/{path}")
            new = self._folders(path)
        else:
            df.write.parquet(f"{self.folder}/{path}")
            new = (path,)
        kept: tuple[str, ...] = ()
        if replacing is not None and self.base and name in self.base.entries:
            gone = {self._run_folder(run) for run in replacing}
            kept = tuple(p for p in self.base.entries[name].paths if p.rsplit("/", 1)[-1] not in gone)
        if appending and self.base and name in self.base.entries:
            kept = self.base.entries[name].paths
        own = Entry(df.schema.json(), partitioned, new)
        if observation:
            written = load(self.spark, self.folder, name, own)
            # A plan found to have no rows is not run, and nothing passes by.
            taken = written.agg(*(c.alias(k) for k, c in observe.items())).first().asDict() if written.isEmpty() else observation.get
            self.figures[name] = taken
        self.entries[name] = Entry(own.schema, partitioned, (*new, *kept))
        return load(self.spark, self.folder, name, self.entries[name])

    def keep(self, name: str) -> None:
        """Take a table over as it is."""
        self.entries[name] = self.base.entries[name]

    def commit(self, options: dict) -> Version:
        """Take the version into use. Of two writers from one base, the second fails."""
        rows = [
            (name, e.schema, e.partitioned, list(e.paths), json.dumps(options), json.dumps(self.figures, default=str))
            for name, e in self.entries.items()
        ]
        target = f"{self.folder}/{MANIFEST}/version={self.number}"
        self.spark.createDataFrame(rows, _ENTRIES).coalesce(1).write.mode("errorifexists").parquet(target)
        return read(self.spark, self.folder, self.number)

    def _files(self, path: str):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folders(self, path: str) -> tuple[str, ...]:
        place, files = self._files(path)
        names = [status.getPath().getName() for status in files.listStatus(place)]
        return tuple(f"{path}/{n}" for n in sorted(names) if n.startswith(f"{RUN}="))

    def _run_folder(self, run: str) -> str:
        utils = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        return utils.getPartitionPathString(RUN, run)


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Delete what none of the newest ``keep`` versions uses, such as the leavings of a publish that failed.

    Not to be run beside a publish, whose folders no manifest names yet. Returns the folders deleted.
    """
    rows = _rows(spark, folder)
    if rows is None:
        return []
    numbers = sorted(r.version for r in rows.select("version").distinct().collect())
    used, names = set(), {r.name for r in rows.select("name").distinct().collect()}
    for number in numbers[-keep:]:
        used |= {p for e in read(spark, folder, number).entries.values() for p in e.paths}
    writer, deleted = Writer(spark, folder), []

    def drop(path: str) -> None:
        place, files = writer._files(path)
        files.delete(place, True)
        deleted.append(path)

    # The manifests first: a version is never listed without its folders.
    for number in numbers[:-keep]:
        drop(f"{MANIFEST}/version={number}")
    for name in sorted(names):
        place, files = writer._files(name)
        for version in sorted(s.getPath().getName() for s in files.listStatus(place)):
            path = f"{name}/{version}"
            inner = writer._folders(path)
            if not inner:
                if path not in used:
                    drop(path)
                continue
            gone = [p for p in inner if p not in used]
            for p in [path] if len(gone) == len(inner) else gone:
                drop(p)
    return deleted
