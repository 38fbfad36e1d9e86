"""Histograms of equal-width bins over a range common to all groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Part of a bin width by which a value may exceed an edge and still count below it, so that
# values lying on an edge do not move with floating-point error (fixed value).
EDGE_TOLERANCE = 1e-8
# Bin width used when all values are equal (fixed value).
SINGLE_BIN_WIDTH = 0.1


def histogram(df: DataFrame, value: str, by: Sequence[str], bins: int, few_values: bool = False) -> DataFrame:
    """Rows per bin and group, empty bins included.

    The width is (max - min) / (bins - 1); edges lie at width / 2 plus whole widths, and the
    lowest bin starts at the highest edge not above the minimum. Bins are closed on the right.

    A first pass finds the range, a second counts the bins, combined before the shuffle: what is shuffled are
    bins, however many values there are. With ``few_values`` the caller states that there are few distinct
    values, as of step counts. The input is then read once, into counts per value, and range, bins and
    groups are all taken from those counts. The result is the same.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("value"))
    if few_values:
        counts = rows.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))
    else:
        counts = rows.withColumn("n", F.lit(1).cast("bigint"))
    span = counts.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi")).alias("span"))
    width = F.col("span.hi") - F.col("span.lo")
    with_grid = (
        counts.withColumn("span", span.scalar())
        .withColumn(
            "width",
            F.when(width > 0, width / (bins - 1 if bins > 1 else 1)).otherwise(F.lit(SINGLE_BIN_WIDTH)),
        )
        .withColumn(
            "origin",
            F.floor((F.col("span.lo") - F.col("width") / 2) / F.col("width")) * F.col("width")
            + F.col("width") / 2,
        )
    )

    def bin_of(v: str):
        edge = F.ceil((F.col(v) - F.col("origin")) / F.col("width") - EDGE_TOLERANCE)
        return F.greatest(edge - 1, F.lit(0)).cast("int")

    binned = with_grid.select(
        *by, bin_of("value").alias("bin"), bin_of("span.hi").alias("last_bin"), "origin", "width", "n"
    )
    if not few_values:
        binned = binned.groupBy(*by, "bin", "last_bin", "origin", "width").agg(F.sum("n").alias("n"))
    empty = binned.select(*by, "last_bin", "origin", "width").distinct().select(
        *by,
        F.explode(F.sequence(F.lit(0), F.col("last_bin"))).alias("bin"),
        "origin",
        "width",
        F.lit(0).cast("bigint").alias("n"),
    )
    start = F.col("origin") + F.col("bin") * F.col("width")
    return (
        binned.drop("last_bin")
        .unionByName(empty)
        .groupBy(*by, "bin", "origin", "width")
        .agg(F.sum("n").alias("n"))
        .select(*by, "bin", start.alias("bin_start"), (start + F.col("width")).alias("bin_end"), "n")
    )


def peak(counts: DataFrame) -> DataFrame:
    """One row: the height of the tallest bin."""
    return counts.agg(F.max("n").alias("y_max"))
