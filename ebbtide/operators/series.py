"""Daily behaviour series per user, and the features and targets cut from them.

A series is long: one row per user and day. Active days travel as one row per user, streaks
are read off that row's days, and only then is it spread over the window, so nothing is
shuffled after the spreading.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.columns import day, rows
from ebbtide.settings import Settings

# Metric order of a series, and the statistics taken from each metric.
METRICS = [
    "session_duration", "sessions_count", "engagement_score", "quiz_attempts",
    "quiz_completions", "content_views", "challenge_interactions", "login_streak",
    "days_since_login",
]
COUNTED = METRICS[:7]
STATISTICS = ["mean", "std", "min", "max", "last", "sum", "active_days"]
FEATURES = [f"{m}_{s}" for m in METRICS for s in STATISTICS] + [f"{m}_slope" for m in METRICS]


def daily_series(daily: DataFrame, users: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """Dense series of the last ``days`` days for every user, from real daily metrics.

    ``daily`` holds at most one row per user and day with ``metric_date`` and the seven
    counted metrics. Days without a row are zero. A login streak counts consecutive
    active days up to the day; ``days_since_login`` is ``days`` until a first active day.
    """
    offset = F.date_diff("metric_date", day(as_of))
    window = daily.where(F.col("metric_date").between(F.date_sub(day(as_of), days), F.date_sub(day(as_of), 1)))
    # One entry per active day, so no list is longer than the window.
    metrics = ", ".join(f"CAST({m} AS double) AS {m}" for m in COUNTED)
    packed = window.select("user_key", offset.alias("day_offset"), F.expr(f"struct({metrics}) AS m")).groupBy(
        "user_key"
    ).agg(F.expr("map_from_entries(collect_list(struct(day_offset, m))) AS by_day"))
    seen = users.select("user_key").join(packed, "user_key", "left").selectExpr(
        "user_key", "by_day", "coalesce(map_keys(by_day), array()) AS active_days",
        f"explode(sequence({-days}, -1)) AS day_offset",
    )
    last_active = "array_max(filter(active_days, d -> d <= day_offset))"
    last_idle = f"array_max(array_except(sequence({-days}, day_offset), active_days))"
    return seen.selectExpr(
        "user_key", "day_offset", "try_element_at(by_day, day_offset) AS m",
        f"CAST(day_offset - coalesce({last_idle}, {-days - 1}) AS double) AS login_streak",
        f"CAST(coalesce(day_offset - {last_active}, {days}) AS double) AS days_since_login",
    ).selectExpr(
        "user_key", "day_offset", *[f"coalesce(m.{m}, 0D) AS {m}" for m in COUNTED], "login_streak", "days_since_login"
    )


def first_half(series: DataFrame, settings: Settings) -> DataFrame:
    return series.where(F.col("day_offset") < -settings.horizon_days)


def second_half(series: DataFrame, settings: Settings) -> DataFrame:
    """Target days, numbered 1 to ``horizon_days``."""
    horizon = (F.col("day_offset") + settings.horizon_days + 1).alias("horizon_day")
    return series.where(F.col("day_offset") >= -settings.horizon_days).select("user_key", horizon, *METRICS)


def series_features(series: DataFrame, settings: Settings) -> DataFrame:
    """72 numbers per user from the first half; users without a full series drop out."""
    early = f"day_offset < -{settings.horizon_days}"
    aggregates = []
    for m in METRICS:
        x = f"CASE WHEN {early} THEN {m} END"
        aggregates += [
            f"avg({x}) AS {m}_mean",
            f"stddev_pop({x}) AS {m}_std",
            f"min({x}) AS {m}_min",
            f"max({x}) AS {m}_max",
            f"max_by({m}, CASE WHEN {early} THEN day_offset END) AS {m}_last",
            f"sum({x}) AS {m}_sum",
            f"CAST(count_if({early} AND {m} > 0) AS double) AS {m}_active_days",
            f"coalesce(regr_slope({x}, day_offset), 0D) AS {m}_slope",
        ]
    per_user = series.groupBy("user_key").agg(F.expr("count(*) AS days"), *[F.expr(a) for a in aggregates])
    return per_user.where(F.col("days") >= settings.history_days).select("user_key", *FEATURES)


def series_targets(series: DataFrame, settings: Settings) -> DataFrame:
    """Second half as (user_key, horizon_day, metric, y)."""
    return second_half(series, settings).select(
        "user_key", "horizon_day",
        rows(F.struct(F.lit(m).alias("metric"), F.col(m).alias("y")) for m in METRICS),
    )


def trend_forecast(features: DataFrame, settings: Settings, decimals: int = 6) -> DataFrame:
    """Straight-line forecast: each metric's first-half line, carried on over the horizon.

    Values are floored at zero and rounded to ``decimals`` places before any threshold looks
    at them, so that the order of floating-point sums cannot move a user across a threshold.
    The nudge of a thousandth of the last place does the same for exact rounding ties.
    """
    days, nudge = settings.horizon_days, 10.0 ** -(decimals + 3)
    ahead = f"(horizon_day + {(days - 1) / 2}D)"
    return features.withColumn("horizon_day", F.explode(F.sequence(F.lit(1), F.lit(days)))).selectExpr(
        "user_key", "horizon_day",
        *[f"round(greatest(0D, {m}_mean + {m}_slope * {ahead}) + {nudge}D, {decimals}) AS {m}" for m in METRICS],
    )
