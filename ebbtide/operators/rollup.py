"""One row per user from the dimension and both facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.sources.star import Star

# Accepted account states, and what a metric defaults to without rows.
KEPT_STATUS = ["active", "pending", "suspended"]
DEFAULTS = {
    "avg_session_duration": "0D",
    "total_sessions": 0,
    "avg_engagement": "50D",
    "days_since_last_login": 15,
    "current_streak": 0,
    "longest_streak": 0,
    "quiz_accuracy": "50D",
    "challenge_completion": "50D",
    "stagnation_days": 10,
    "total_quiz_attempts": 0,
    "total_quiz_completions": 0,
    "total_quiz_abandons": 0,
    "total_content_views": 0,
    "total_challenge_interactions": 0,
}
TOTALS = {
    "total_sessions": "session_count",
    "total_quiz_attempts": "quiz_attempts",
    "total_quiz_completions": "quiz_completions",
    "total_quiz_abandons": "quiz_abandons",
    "total_content_views": "content_views",
    "total_challenge_interactions": "challenge_interactions",
}


AVERAGES = {
    "avg_engagement": "engagement_score",
    "quiz_accuracy": "quiz_accuracy_percentage",
    "challenge_completion": "challenge_completion_rate",
}
MAXIMA = ["days_since_last_login", "current_streak", "longest_streak", "stagnation_days"]


def activity_per_user(activity: DataFrame) -> DataFrame:
    return activity.groupBy("user_key").agg(
        F.expr("avg(avg_session_duration) AS avg_session_duration"),
        F.expr("max(last_activity_date) AS last_active"),
        *[F.expr(f"sum({source}) AS {name}") for name, source in TOTALS.items()],
    )


def engagement_per_user(engagement: DataFrame) -> DataFrame:
    return engagement.groupBy("user_key").agg(
        F.expr("count(*) AS engagement_rows"),
        *[F.expr(f"avg({source}) AS {name}") for name, source in AVERAGES.items()],
        *[F.expr(f"max({name}) AS {name}") for name in MAXIMA],
    )


def user_rollup(star: Star, fanout: str = "compat") -> DataFrame:
    """Join the dimension with both facts and aggregate per user.

    Joining two facts to one dimension in a single statement repeats every activity row
    once per engagement row, and the sums of the warehouse query include that.
    ``fanout="compat"`` reproduces those sums without building the product: each fact is
    aggregated first and the sums are multiplied by the engagement row count.
    ``fanout="corrected"`` leaves the multiplication out. Averages and maxima are the
    same either way.
    """
    return finish_rollup(star.users, activity_per_user(star.activity), engagement_per_user(star.engagement), fanout)


def finish_rollup(users: DataFrame, activity: DataFrame, engagement: DataFrame, fanout: str) -> DataFrame:
    """The roll-up from the dimension and one row per user of each fact."""
    if fanout not in ("compat", "corrected"):
        raise ValueError("fanout must be 'compat' or 'corrected'")
    joined = (
        users.where(F.col("account_status").isin(KEPT_STATUS))
        .join(activity, "user_key", "left")
        .join(engagement, "user_key", "left")
    )
    copies = "greatest(coalesce(engagement_rows, 0), 1)" if fanout == "compat" else "1"
    values = {name: f"{name} * {copies}" if name in TOTALS else name for name in DEFAULTS}
    return joined.selectExpr(
        "user_key",
        "user_id",
        "email",
        "age",
        "account_status",
        "is_verified",
        "registration_date",
        "coalesce(last_active, registration_date) AS last_activity_date",
        *[f"coalesce({values[name]}, {default}) AS {name}" for name, default in DEFAULTS.items()],
    )
