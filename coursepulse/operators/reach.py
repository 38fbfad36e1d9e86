"""Distinct learners as bitmaps that merge: exact counts over any set of runs without the activity.

Every learner has a number, kept in a table that only grows. The learners of a run, or of a week of a run, are the
bits of a bitmap, in buckets of 32,768 numbers. Bitmaps of several runs are combined bit by bit, so a
learner of two runs counts once, and adding a run reads that run's rows alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursepulse.operators.distributions import retention_of

#: Numbers are dealt out in blocks of 2 ** 33, one for each task.
BLOCK_BITS = 33


def number_learners(ids: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(learner_id, number) of the learners that ``known`` has no number for.

    Numbers come out anew with every computation: store the result before it is used. Rows without a learner get none.
    """
    new = ids.select("learner_id").where(F.col("learner_id").isNotNull()).distinct()
    first = 0
    if known is not None:
        new = new.join(known, "learner_id", "left_anti")
        last = known.agg(F.max("number")).first()[0]
        first = 0 if last is None else ((last >> BLOCK_BITS) + 1) << BLOCK_BITS
    return new.withColumn("number", F.monotonically_increasing_id() + F.lit(first).cast("bigint"))


def reach(rows: DataFrame, numbers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bitmaps of the learners of each group: keys, bucket, learners."""
    numbered = rows.select(*keys, "learner_id").distinct().join(numbers, "learner_id")
    return numbered.groupBy(*keys, F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("learners")
    )


def distinct_learners(reach: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Distinct learners of each group of bitmaps; of all of them, one row, where there are no keys."""
    merged = reach.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("learners").alias("learners"))
    return merged.groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count("learners")), F.lit(0)).cast("bigint").alias(name))


def never_active(enrolled: DataFrame, active: DataFrame) -> DataFrame:
    """Distinct learners enrolled and active over all runs, and the difference of the two."""
    n_active = distinct_learners(active, [], "n").scalar()
    return (
        distinct_learners(enrolled, [], "enrolled_learners")
        .withColumn("active_learners", n_active)
        .withColumn("never_active", F.col("enrolled_learners") - F.col("active_learners"))
    )


def weekly_retention(weeks: DataFrame, by_run: bool = False) -> DataFrame:
    """Distinct learners per week, and as a percentage of the first week, from bitmaps by run and week."""
    keys = [*(["course_run"] if by_run else []), "week_number"]
    return retention_of(distinct_learners(weeks, keys, "active_learners"), by_run)
