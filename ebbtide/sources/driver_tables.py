"""Adapter from the order/event tables of the test data to the star schema.

It stands in for a warehouse load: customers become users, their events become daily
activity and their orders become yearly engagement. Every row counts, dates are the
tables' own, and what users did last comes from timestamps.
"""

from __future__ import annotations

import hashlib
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.sources.star import Star, make_star

AS_OF = date(2024, 1, 31)


# Declared, so that no job has to read file footers to infer them.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
              " o_orderdate timestamp_ntz, o_orderpriority string",
}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{folder}/{table}.parquet")


def tables_mark(spark: SparkSession, folder: str) -> str:
    """Changes with any file of the tables: its name, size or time."""
    marks = []
    for table in SCHEMAS:
        files = read(spark, folder, table).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        marks += files.agg(F.count("*"), F.bit_xor(F.xxhash64(*files.columns))).first()
    return hashlib.sha256(str(marks).encode()).hexdigest()[:16]


def daily_activity(
    spark: SparkSession, folder: str, since: date | None = None, until: date | None = None
) -> DataFrame:
    """One row per user and active day, of the days from ``since`` to ``until`` if given.

    The bounds are plain comparisons on ``ts``, so they reach the scan."""
    events = read(spark, folder, "events")
    if since is not None:
        events = events.where(F.expr(f"ts >= TIMESTAMP_NTZ '{since} 00:00:00'"))
    if until is not None:
        events = events.where(F.expr(f"ts < TIMESTAMP_NTZ '{until + timedelta(days=1)} 00:00:00'"))
    return (
        events.selectExpr(
            "user_id AS user_key", "to_date(ts) AS last_activity_date", "hour(ts) AS hour", "event_type AS kind", "value"
        )
        .groupBy("user_key", "last_activity_date")
        .agg(
            # Distinct hours as bits of one integer: merges map-side, unlike count(distinct).
            F.expr("CAST(bit_count(bit_or(1 << hour)) AS bigint) AS session_count"),
            F.expr("avg(value) AS avg_session_duration"),
            F.expr("least(100D, sum(value)) AS engagement_score"),
            F.expr("count_if(kind IN ('click', 'purchase')) AS quiz_attempts"),
            F.expr("count_if(kind = 'purchase') AS quiz_completions"),
            F.expr("count_if(kind = 'error') AS quiz_abandons"),
            F.expr("count_if(kind = 'view') AS content_views"),
            F.expr("count_if(kind = 'signup') AS challenge_interactions"),
        )
    )


def yearly_orders(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer and year with an order."""
    return read(spark, folder, "orders").groupBy(
        F.col("o_custkey").alias("user_key"), F.year("o_orderdate").alias("year")
    ).agg(
        F.expr("least(100D, avg(o_totalprice) / 5000) AS engagement_score"),
        F.expr("least(100D, max(o_totalprice) / 5000) AS challenge_completion_rate"),
        F.expr("100 * avg(CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS int)) AS quiz_accuracy_percentage"),
        # Months with an order, as bits.
        F.expr("CAST(bit_count(bit_or(1 << month(o_orderdate))) AS int) AS current_streak"),
        F.expr("CAST(count(*) AS int) AS longest_streak"),
        F.expr("to_date(min(o_orderdate)) AS first_order"),
    )


def users(spark: SparkSession, folder: str, orders: DataFrame) -> DataFrame:
    """Customers, registered on the day of their first order."""
    registered = orders.groupBy("user_key").agg(F.min("first_order").alias("registration_date"))
    return read(spark, folder, "customer").selectExpr(
        "c_custkey AS user_key",
        "c_name AS user_id",
        "CAST(NULL AS string) AS email",
        "CAST(IF(c_acctbal >= 0, 13 + CAST(c_acctbal AS int) % 52, NULL) AS int) AS age",
        "coalesce(map('MACHINERY', 'suspended', 'FURNITURE', 'pending', 'AUTOMOBILE', 'deleted')"
        "[c_mktsegment], 'active') AS account_status",
        "c_acctbal > 0 AS is_verified",
    ).join(registered, "user_key", "left")


def yearly_engagement(orders: DataFrame, activity: DataFrame, as_of: date = AS_OF) -> DataFrame:
    """Engagement by year; days since the last event and the last purchase are null without one."""
    bought = F.when(F.col("quiz_completions") > 0, F.col("last_activity_date"))
    last = activity.groupBy("user_key").agg(
        F.date_diff(F.lit(as_of), F.max("last_activity_date")).alias("days_since_last_login"),
        F.date_diff(F.lit(as_of), F.max(bought)).alias("stagnation_days"),
    )
    return orders.join(last, "user_key", "left")


def driver_star(
    spark: SparkSession, folder: str, as_of: date = AS_OF, activity: DataFrame | None = None, orders: DataFrame | None = None
) -> Star:
    activity = daily_activity(spark, folder) if activity is None else activity
    orders = yearly_orders(spark, folder) if orders is None else orders
    return make_star(users(spark, folder, orders), activity, yearly_engagement(orders, activity, as_of))


def daily_metrics(activity: DataFrame) -> DataFrame:
    """A daily roll-up under the metric names a behaviour series uses."""
    return activity.selectExpr(
        "user_key", "last_activity_date AS metric_date", "avg_session_duration AS session_duration",
        "session_count AS sessions_count", "engagement_score", "quiz_attempts", "quiz_completions",
        "content_views", "challenge_interactions",
    )
