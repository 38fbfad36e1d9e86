"""Named tables in a folder as Parquet, large ones partitioned by course run."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from coursepulse.model import LEARNER_KEYS, require_names

OPTIONS = "options_of_tables"
BUCKETS = "_layout"


def publish(df: DataFrame, folder: str, name: str, partitioned: bool = False) -> DataFrame:
    """Write a table, replacing an earlier one, and return it as read back.

    The table read back has known sizes and no lineage: later joins can be planned on it, and
    a lost executor costs a re-read instead of a recomputation.
    """
    if partitioned:
        # Rows of a run come together, a large run in several parts: few files, no hot task.
        writer = df.hint("rebalance", "course_run").write.mode("overwrite").partitionBy("course_run")
    else:
        writer = df.write.mode("overwrite")
    writer.parquet(f"{folder}/{name}")
    return load(df.sparkSession, folder, name)


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the folder that spark.checkpoint.dir names, so that a lost executor costs a re-read.

    Where the session names none, a local session gets a temporary folder; a cluster is refused.
    """
    context, spark = df.sparkSession.sparkContext, df.sparkSession
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master.partition("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="coursepulse-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def save_options(spark: SparkSession, folder: str, options: dict) -> None:
    """Write the options that published tables were derived with."""
    spark.createDataFrame([(json.dumps(options),)], "options string").coalesce(1).write.mode("overwrite").parquet(
        f"{folder}/{OPTIONS}"
    )


def load_options(spark: SparkSession, folder: str) -> dict | None:
    """The options of a published folder; None if none were written."""
    if not _exists(spark, f"{folder}/{OPTIONS}"):
        return None
    return json.loads(spark.read.parquet(f"{folder}/{OPTIONS}").first().options)


def save_bucketed(df: DataFrame, folder: str, name: str, buckets: int) -> DataFrame:
    """Write a catalog table bucketed by learner and run, one file per bucket, and return it.

    Tables of equal bucket number group and join by learner without a shuffle. A bucket holds
    all rows of its learners, so store tables whose rows per learner are bounded, such as the
    cleaned activity, and not the raw one. A catalog table of that name at another place is
    another course's, and is refused.
    """
    spark, path = df.sparkSession, f"{folder}/{name}"
    if spark.catalog.tableExists(name) and not _is_at(spark, name, path):
        raise ValueError(f"table {name} exists at another place; choose another prefix")
    (
        df.repartition(buckets, *LEARNER_KEYS)
        .write.mode("overwrite")
        .bucketBy(buckets, *LEARNER_KEYS)
        .option("path", path)
        .saveAsTable(name)
    )
    save_options(spark, f"{folder}/{name}{BUCKETS}", {"buckets": buckets, "schema": spark.table(name).schema.json()})
    return spark.table(name)


def open_bucketed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table that ``save_bucketed`` wrote, registered again where the catalog lost it."""
    path = f"{folder}/{name}"
    if not spark.catalog.tableExists(name):
        layout = load_options(spark, f"{path}{BUCKETS}")
        if layout is None:
            raise ValueError(f"no bucketed table at {path}")
        fields = T.StructType.fromJson(json.loads(layout["schema"])).fields
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        keys = ", ".join(LEARNER_KEYS)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (path '{path}') "
            f"CLUSTERED BY ({keys}) INTO {layout['buckets']} BUCKETS"
        )
    elif not _is_at(spark, name, path):
        raise ValueError(f"table {name} exists at another place")
    return spark.table(name)


def _is_at(spark: SparkSession, name: str, path: str) -> bool:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").collect()
    return bool(rows) and rows[0].data_type.removeprefix("file:").rstrip("/") == path.removeprefix("file:").rstrip("/")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read a published table; run names stay text even where they look like numbers."""
    path = f"{folder}/{name}"
    found = spark.read.parquet(path).schema
    fields = [
        T.StructField("course_run", T.StringType()) if f.name == "course_run" else f for f in found
    ]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def published(spark: SparkSession, folder: str, names: Iterable[str]) -> list[str]:
    """Those of ``names`` that exist in the folder."""
    return [name for name in names if _exists(spark, f"{folder}/{name}")]


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def require_published(spark: SparkSession, folder: str, names: Iterable[str]) -> None:
    """Raise, listing the missing ones, unless every named table is published."""
    names = list(names)
    require_names(names, published(spark, folder, names))
