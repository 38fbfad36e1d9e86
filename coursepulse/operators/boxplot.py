"""Box-plot statistics and outliers of measures in long form, exact for every group size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coursepulse.operators.distributions import ENGAGEMENT_METRICS

METRICS = tuple(ENGAGEMENT_METRICS.values())
GROUP = ("metric", "completed")
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
# Whisker reach in interquartile ranges (fixed value).
REACH = 1.5
# Sub-ranges per doubling of a value; a double spans some 2,000 doublings.
SUBRANGES = 1_024
# A list of this many metrics bounds the tables of one row per group; they may then be broadcast.
FEW_METRICS = 1_000
# The two ranks that a quartile lies between.
EDGES = {"low": F.floor, "high": F.ceil}


def _values(long: DataFrame, metrics: Sequence[str] | None) -> DataFrame:
    present = long.where(F.col("value").isNotNull())
    return present if metrics is None else present.where(F.col("metric").isin(list(metrics)))


def _per_group(small: DataFrame, metrics: Sequence[str] | None) -> DataFrame:
    """A table of a few rows per group; its size is known only if the metrics are listed."""
    return F.broadcast(small) if metrics is not None and len(metrics) <= FEW_METRICS else small


def _subrange() -> Column:
    """Number of the fixed sub-range a value lies in; grows with the value."""
    value = F.col("value")
    return F.floor(F.signum(value) * F.log2(1 + F.abs(value)) * SUBRANGES)


def quartiles(long: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """Exact quartiles (linear interpolation) per metric and completion flag.

    A first pass counts the values of each sub-range, combined before the shuffle, which tells the
    sub-ranges that hold the ranks sought (two for each quartile). A second pass counts the
    distinct values of those sub-ranges alone. No rank can be missed, whatever the group's size;
    a group whose values all lie in one sub-range costs a sort of its distinct values.

    ``metrics`` limits the groups; without it every metric there is gets its quartiles.
    """
    values = _values(long, metrics).withColumn("subrange", _subrange())
    counted = values.groupBy(*GROUP, "subrange").agg(F.count(F.lit(1)).alias("n"))
    group = W.partitionBy(*GROUP)
    placed = counted.select(
        *GROUP,
        "subrange",
        (F.sum("n").over(group.orderBy("subrange")) - F.col("n")).alias("before"),
        "n",
        F.sum("n").over(group).alias("total"),
    )
    ranks = {name: (F.col("total") - 1) * F.lit(p) for name, p in QUARTILES.items()}
    sought = [edge(rank) for rank in ranks.values() for edge in EDGES.values()]

    def holds(first: Column, n: Column) -> Column:
        return F.exists(F.array(*sought), lambda rank: (rank >= first) & (rank < first + n))

    targets = placed.where(holds(F.col("before"), F.col("n"))).select(*GROUP, "subrange", "before", "total")
    near = values.join(_per_group(targets, metrics), [*GROUP, "subrange"])
    distinct = near.groupBy(*GROUP, "subrange", "before", "total", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy(*GROUP, "subrange").orderBy("value"))
    first = distinct.withColumn("first", F.col("before") + upto - F.col("n"))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("first")) & (rank < F.col("first") + F.col("n")), F.col("value")))

    found = first.groupBy(*GROUP, "total").agg(
        *(at(edge(rank)).alias(f"{name}_{e}") for name, rank in ranks.items() for e, edge in EDGES.items())
    )

    def between(name: str) -> Column:
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        return low + (ranks[name] - F.floor(ranks[name])) * (high - low)

    return found.select(*GROUP, *(between(name).alias(name) for name in QUARTILES))


def _with_fences(long: DataFrame, metrics: Sequence[str] | None) -> DataFrame:
    """Values with the quartiles and fences of their group."""
    reach = (F.col("q3") - F.col("q1")) * REACH
    fences = quartiles(long, metrics).withColumns(
        {"lower_fence": F.col("q1") - reach, "upper_fence": F.col("q3") + reach}
    )
    return _values(long, metrics).join(_per_group(fences, metrics), list(GROUP))


def _outside() -> Column:
    return (F.col("value") < F.col("lower_fence")) | (F.col("value") > F.col("upper_fence"))


def box_statistics(long: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """Quartiles, whiskers and number of outliers per metric and completion flag.

    A whisker ends at the furthest value within the fence, and never inside the box.
    """
    inside = F.when(~_outside(), F.col("value"))
    return (
        _with_fences(long, metrics)
        .groupBy(*GROUP, "q1", "median", "q3")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(inside).alias("lowest"),
            F.max(inside).alias("highest"),
            F.count_if(_outside()).alias("n_outliers"),
        )
        .select(
            *GROUP,
            "n",
            F.least("lowest", "q1").alias("lower_whisker"),
            "q1",
            "median",
            "q3",
            F.greatest("highest", "q3").alias("upper_whisker"),
            "n_outliers",
        )
    )


def outliers(long: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """Values beyond the fences of their group."""
    return _with_fences(long, metrics).where(_outside()).select(*long.columns)
