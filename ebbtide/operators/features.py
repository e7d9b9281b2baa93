"""Derived, leak-safe and imputed features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.columns import is_positive, number, ratio
from ebbtide.operators.order_stats import exact_quantiles

# Which columns a model may see, and which get their median when empty.
MEDIAN_FILLED = ["age", "quiz_accuracy", "challenge_completion", "avg_session_duration"]
ZERO_FILLED = [
    "total_quiz_attempts", "total_quiz_completions", "total_quiz_abandons",
    "total_content_views", "total_challenge_interactions", "total_sessions", "longest_streak",
]
SAFE_FEATURES = [
    "age", "total_quiz_attempts", "total_quiz_completions", "total_quiz_abandons",
    "total_content_views", "total_challenge_interactions", "total_sessions",
    "quiz_accuracy", "challenge_completion", "avg_session_duration", "longest_streak",
    "quiz_success_rate", "quiz_abandon_rate", "activity_diversity",
    "total_activity_volume", "activity_per_session", "quiz_efficiency",
]


def _diversity() -> Column:
    return (
        is_positive(F.col("total_quiz_attempts"))
        + is_positive(F.col("total_content_views"))
        + is_positive(F.col("total_challenge_interactions"))
    )


def derived_features(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns({
        "session_frequency": c("total_sessions") / 30.0,
        "quiz_completion_rate": ratio(c("total_quiz_completions"), c("total_quiz_attempts")),
        "quiz_abandon_rate": ratio(c("total_quiz_abandons"), c("total_quiz_attempts")),
        "engagement_trend": c("avg_engagement") - c("stagnation_days") / 30.0 * 100.0,
        "activity_diversity": _diversity(),
        "challenge_success_ratio": c("challenge_completion") / 100.0,
        "consistency_index": ratio(c("current_streak"), c("longest_streak")),
    })


def fill_values(df: DataFrame) -> dict[str, float]:
    """Medians of the median-filled columns that have a gap; others need none."""
    present = [c for c in MEDIAN_FILLED if c in df.columns]
    gaps = df.agg(*[F.count_if(number(F.col(c)).isNull()).alias(c) for c in present]).first()
    holed = [c for c in present if gaps[c]]
    return {c: values[0] for c, values in exact_quantiles(df, holed, [0.5]).items() if values[0] is not None}


def impute(df: DataFrame, medians: dict[str, float] | None = None) -> DataFrame:
    """Fill gaps with the column's exact median, or with zero for counters."""
    medians = fill_values(df) if medians is None else medians
    zeros = {c: F.coalesce(c, F.lit(0)) for c in ZERO_FILLED if c in df.columns}
    filled = {c: F.coalesce(number(F.col(c)), F.lit(m)) for c, m in medians.items()}
    return df.withColumns({**zeros, **filled})


def safe_features(df: DataFrame) -> DataFrame:
    """Six ratios that do not look at recent time, so they cannot leak the label."""
    c = F.col
    volume = c("total_quiz_attempts") + c("total_content_views") + c("total_challenge_interactions")
    return df.withColumns({
        "quiz_success_rate": ratio(c("total_quiz_completions"), c("total_quiz_attempts")),
        "quiz_abandon_rate": ratio(c("total_quiz_abandons"), c("total_quiz_attempts")),
        "activity_diversity": _diversity(),
        "total_activity_volume": volume,
        "activity_per_session": ratio(volume, c("total_sessions")),
        "quiz_efficiency": ratio(c("total_quiz_completions"), c("total_sessions")),
    })
