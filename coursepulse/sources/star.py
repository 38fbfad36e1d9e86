"""Orders star schema read as course data: a customer is a learner, an order priority a run.

The two functions give the canonical ``step_activity`` and ``enrolments`` tables, so that the
library can be checked and timed on generated tables of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns read, with their types; nothing is inferred from the files (fixed values).
SCHEMAS = {
    "nation": "n_nationkey int, n_name string",
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_returnflag string, l_shipdate timestamp_ntz"
    ),
}


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{folder}/{table}.parquet")


def step_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as step visits; returned items are visits without completion."""
    orders = _read(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    lines = _read(spark, folder, "lineitem")
    completed = F.expr("timestampadd(DAY, int(l_quantity), l_shipdate)")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_orderpriority").alias("course_run"),
            F.col("o_custkey").alias("learner_id"),
            (F.col("l_suppkey") % 3 + 1).cast("int").alias("week_number"),
            F.col("l_linenumber").cast("int").alias("step_number"),
            F.col("l_shipdate").alias("first_visited_at"),
            F.when(F.col("l_returnflag") == "R", F.lit(None))
            .otherwise(completed)
            .alias("last_completed_at"),
        )
        .select(
            "course_run",
            "learner_id",
            F.concat_ws(".", "week_number", "step_number").alias("step"),
            "week_number",
            "step_number",
            "first_visited_at",
            "last_completed_at",
            F.col("last_completed_at").isNotNull().alias("step_completed"),
        )
    )


def _age_range():
    balance = F.col("c_acctbal")
    return (
        F.when(F.col("c_custkey") % 997 == 0, ">65")
        .when(balance < 0, "Unknown")
        .when(balance < 2500, "18-25")
        .when(balance < 5000, "26-35")
        .when(balance < 7500, "36-45")
        .otherwise("46-55")
    )


def _pick(number, values: list[str]):
    """The value at position ``number`` modulo the number of values."""
    return F.get(F.array(*map(F.lit, values)), (number % len(values)).cast("int"))


def enrolments(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer in every run; their orders there give the dates."""
    orders = _read(spark, folder, "orders")
    finished = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") >= 350000)
    dates = orders.groupBy(
        F.col("o_custkey").alias("learner_id"), F.col("o_orderpriority").alias("course_run")
    ).agg(
        F.min("o_orderdate").alias("first_order"),
        F.max(F.when(finished, F.col("o_orderdate"))).alias("fully_participated_at"),
    )
    nations = _read(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    # One entry per run, and each run is one value of the schema's few priorities.
    runs = orders.agg(F.collect_set("o_orderpriority")).scalar()
    none = F.lit(None).cast("timestamp_ntz")
    key = F.col("c_custkey")
    learners = (
        _read(spark, folder, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.explode(runs).alias("course_run"),
            key.alias("learner_id"),
            _pick(F.col("c_nationkey"), ["male", "female", "Unknown"]).alias("gender"),
            "country",
            _age_range().alias("age_range"),
            _pick(key, ["Unknown", "secondary", "bachelor", "master", "doctorate"]).alias(
                "highest_education_level"
            ),
            _pick(key, ["Unknown", "full_time", "part_time", "looking"]).alias("employment_status"),
            F.when(F.col("c_mktsegment") == "HOUSEHOLD", "Unknown")
            .otherwise(F.col("c_mktsegment"))
            .alias("employment_area"),
        )
    )
    return learners.join(dates, ["learner_id", "course_run"], "left").select(
        "learner_id",
        "course_run",
        F.coalesce("first_order", F.lit("1995-01-01").cast("timestamp_ntz")).alias("enrolled_at"),
        none.alias("unenrolled_at"),
        "fully_participated_at",
        none.alias("purchased_statement_at"),
        "gender",
        "country",
        "age_range",
        "highest_education_level",
        "employment_status",
        "employment_area",
    )
