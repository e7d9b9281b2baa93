"""The star schema the engine reads: one user dimension and two facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Table and column names of the warehouse.
USERS = T.StructType([
    T.StructField("user_key", T.LongType(), False),
    T.StructField("user_id", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("account_status", T.StringType()),
    T.StructField("is_verified", T.BooleanType()),
    T.StructField("registration_date", T.DateType()),
])
ACTIVITY = T.StructType([
    T.StructField("user_key", T.LongType(), False),
    T.StructField("avg_session_duration", T.DoubleType()),
    T.StructField("session_count", T.LongType()),
    T.StructField("last_activity_date", T.DateType()),
    T.StructField("quiz_attempts", T.LongType()),
    T.StructField("quiz_completions", T.LongType()),
    T.StructField("quiz_abandons", T.LongType()),
    T.StructField("content_views", T.LongType()),
    T.StructField("challenge_interactions", T.LongType()),
])
ENGAGEMENT = T.StructType([
    T.StructField("user_key", T.LongType(), False),
    T.StructField("engagement_score", T.DoubleType()),
    T.StructField("days_since_last_login", T.IntegerType()),
    T.StructField("current_streak", T.IntegerType()),
    T.StructField("longest_streak", T.IntegerType()),
    T.StructField("quiz_accuracy_percentage", T.DoubleType()),
    T.StructField("challenge_completion_rate", T.DoubleType()),
    T.StructField("stagnation_days", T.IntegerType()),
])
TABLES = {"dim_users": USERS, "fact_user_activity": ACTIVITY, "fact_user_engagement": ENGAGEMENT}


@dataclass(frozen=True)
class Star:
    users: DataFrame
    activity: DataFrame
    engagement: DataFrame


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to the declared columns and types; an absent column is an error here."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.selectExpr(*[f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema])


def make_star(users: DataFrame, activity: DataFrame, engagement: DataFrame) -> Star:
    return Star(conform(users, USERS), conform(activity, ACTIVITY), conform(engagement, ENGAGEMENT))


def load_star(spark: SparkSession, folder: str) -> Star:
    """Read the three tables from ``folder/<table>`` in parquet."""
    return make_star(*[spark.read.parquet(f"{folder}/{name}") for name in TABLES])


def star_from_catalog(spark: SparkSession, database: str = "analytics") -> Star:
    """Read the three tables from the session catalog (any format it knows)."""
    return make_star(*[spark.table(f"{database}.{name}") for name in TABLES])


def run_sql(spark: SparkSession, star: Star, text: str) -> DataFrame:
    """Run a query over the star's tables, written as ``{dim_users}`` and so on in the text."""
    return spark.sql(
        text,
        dim_users=star.users,
        fact_user_activity=star.activity,
        fact_user_engagement=star.engagement,
    )
