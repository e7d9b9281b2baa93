"""Churn definitions and risk categories over the user roll-up."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.functions.columns import day, share
from ebbtide.operators.noise import add_noise, flip_labels
from ebbtide.settings import Settings

# Output columns of the two user tables, in order.
BASE_COLUMNS = [
    "user_key", "user_id", "email", "age", "avg_session_duration", "total_sessions",
    "last_activity_date", "avg_engagement", "days_since_last_login", "current_streak",
    "longest_streak", "quiz_accuracy", "challenge_completion", "stagnation_days",
    "total_quiz_attempts", "total_quiz_completions", "total_quiz_abandons",
    "total_content_views", "total_challenge_interactions", "churned",
    "days_since_last_activity", "account_status", "is_verified",
]
REALISTIC_COLUMNS = [
    "user_key", "user_id", "email", "age", "account_status", "registration_date",
    "avg_session_duration", "total_sessions", "last_activity_date", "avg_engagement",
    "current_streak", "longest_streak", "quiz_accuracy", "challenge_completion",
    "total_quiz_attempts", "total_quiz_completions", "total_quiz_abandons",
    "total_content_views", "total_challenge_interactions", "churned_realistic",
    "risk_category",
]
DEFAULT_AGE = 13


def inactive_for(days: int, as_of: date) -> Column:
    """Last activity strictly more than ``days`` days before ``as_of``."""
    return F.col("last_activity_date") < F.date_sub(day(as_of), days)


def first_match(*conditions: Column) -> Column:
    """1 when any condition is true; a null condition does not count."""
    return F.when(F.coalesce(*[F.when(c, 1) for c in conditions]) == 1, 1).otherwise(0)


def base_churn(as_of: date) -> Column:
    login, engagement = F.col("days_since_last_login"), F.col("avg_engagement")
    return first_match(
        F.col("last_activity_date").isNull(),
        inactive_for(14, as_of),
        login > 14,
        F.col("account_status") == "suspended",
        (login > 10) & (engagement < 30),
        (login > 7) & (F.col("total_sessions") < 5),
        F.col("stagnation_days") > 20,
    )


def days_inactive(as_of: date) -> Column:
    last = F.col("last_activity_date")
    return F.when(last.isNull(), 30).otherwise(F.greatest(F.lit(0), F.date_diff(day(as_of), last)))


def realistic_churn(as_of: date) -> Column:
    return first_match(
        inactive_for(30, as_of),
        F.col("account_status") == "suspended",
        (F.col("total_sessions") < 3) & (F.col("avg_engagement") < 25),
    )


def risk_category(as_of: date) -> Column:
    return (
        F.when(inactive_for(21, as_of), "high_risk")
        .when(inactive_for(14, as_of), "medium_risk")
        .when((F.col("avg_engagement") < 30) & (F.col("total_sessions") < 5), "low_engagement")
        .otherwise("active")
    )


def label_base(rollup: DataFrame, as_of: date) -> DataFrame:
    """The user feature table: default age, base churn label, days since last activity."""
    return rollup.withColumns({
        "age": F.coalesce("age", F.lit(DEFAULT_AGE)),
        "churned": base_churn(as_of),
        "days_since_last_activity": days_inactive(as_of),
    }).select(BASE_COLUMNS)


def label_realistic(rollup: DataFrame, as_of: date) -> DataFrame:
    """The stricter churn definition with a risk category; ages stay as they are."""
    return rollup.withColumns({
        "churned_realistic": realistic_churn(as_of),
        "risk_category": risk_category(as_of),
    }).select(REALISTIC_COLUMNS)


def label_stats(df: DataFrame, label: str = "churned") -> DataFrame:
    """Users, and their percentage, per label value."""
    return _distribution(df, label)


def risk_distribution(realistic: DataFrame) -> DataFrame:
    return _distribution(realistic, "risk_category")


def _distribution(df: DataFrame, column: str) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("users"))
    # One row per class, so the unpartitioned window holds a handful of rows.
    total = F.sum("users").over(W.partitionBy())
    return counts.select(column, "users", share(F.col("users"), total).alias("percentage"))


def label_rate(df: DataFrame, label: str = "churned") -> DataFrame:
    return df.agg(
        F.count("*").alias("total_records"),
        F.coalesce(F.sum(label), F.lit(0)).alias("positives"),
        (100.0 * F.avg(label)).alias("churn_rate"),
    )


def choose_labels(base: DataFrame, realistic: DataFrame, settings: Settings) -> tuple[DataFrame, str]:
    """Take the realistic labels when they have enough positives, else noisy base labels."""
    positives = realistic.agg(F.sum("churned_realistic")).first()[0] or 0
    if positives >= settings.min_positives:
        return realistic.drop("churned").withColumnRenamed("churned_realistic", "churned"), "realistic"
    noisy = add_noise(base, settings.noise_level, settings.seed)
    return flip_labels(noisy, settings.flip_rate, settings.seed), "noisy"
