"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: What the operators take as white space; the same bytes as in bytes.split().
SPACES = " \t\n\x0b\x0c\r"
#: Entries a task keeps in a table of words before it starts a new one.
MAX_CACHED = 200_000
#: Rows that a task works on at once.
ROWS = 1_000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, as spark.checkpoint.dir names it.

    Where the session names none, a local session gets a temporary folder; a cluster is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="coursepulse-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, lineage cut."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(context: SparkContext) -> None:
    """Give the Python workers this package, as spark-submit's --py-files would."""
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="coursepulse-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow, where run may use this package.

    Texts are long, so the session's Arrow batches are lowered to ROWS rows if they are larger.
    """
    ship(df.sparkSession.sparkContext)
    if int(df.sparkSession.conf.get(BATCH)) not in range(1, ROWS + 1):
        df.sparkSession.conf.set(BATCH, ROWS)
    return df.mapInArrow(run, schema)


def append_columns(
    df: DataFrame,
    inputs: Sequence[str],
    outputs: Sequence[T.StructField],
    start: Callable[[], Callable[..., list[pa.Array]]],
) -> DataFrame:
    """df with further columns that Python computes batch by batch.

    start() runs once in each task and returns the function from the input columns (Arrow arrays)
    to the output columns. Columns of df that carry an output's name are replaced.
    """
    new = {f.name.lower() for f in outputs}
    at = [df.columns.index(c) for c in inputs]
    keep = [i for i, c in enumerate(df.columns) if c.lower() not in new]
    schema = T.StructType([df.schema[i] for i in keep] + list(outputs))
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for whole in batches:
            for first in range(0, len(whole), ROWS):
                batch = whole.slice(first, ROWS)
                made = compute(*(batch.column(i) for i in at))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *made], names=names)

    return map_arrow(df, run, schema)


def utf8(texts: pa.Array) -> list[bytes | None]:
    """The texts' bytes, without decoding them."""
    return texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary()).to_pylist()


class WordHashes(dict):
    """64-bit hash of each word (bytes), remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_CACHED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` neighbouring words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out += hashes[i : i + n]
        mixed(out)
    return out
