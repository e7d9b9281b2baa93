"""Bounded reports and the data sets behind each chart."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.operators.curves import curve_areas, pr_points, roc_points, threshold_totals
from ebbtide.operators.labels import label_stats
from ebbtide.operators.risk import forecast_totals, high_risk, ranked, risk_bands, status_counts
from ebbtide.sources.sinks import typed


def first_forecasts(forecast: DataFrame, n: int = 100) -> DataFrame:
    return forecast.orderBy("user_key", "prediction_day").limit(n)


def high_risk_report(forecast: DataFrame, risk: DataFrame, n: int = 100) -> dict[str, DataFrame]:
    """High-risk users by risk, how many there are, and the first forecast rows."""
    users = high_risk(risk).select("user_id", "avg_churn_risk")
    return {
        "high_risk_users": users,
        "total_high_risk": users.agg(F.count("*").alias("total_high_risk")),
        "predictions": first_forecasts(forecast, n),
    }


def top_recommendations(recommended: DataFrame, n: int = 20) -> DataFrame:
    return typed(ranked(recommended, n))


def detailed_users(recommended: DataFrame, n: int = 5) -> DataFrame:
    """The riskiest users, one nested row each, with their rank."""
    churned = F.col("current_churned_status") == 1
    top = ranked(recommended, n)
    # At most n rows, so the unpartitioned window is small.
    place = F.row_number().over(W.orderBy(F.col("avg_churn_risk").desc(), "user_key"))
    return top.select(
        place.alias("rank"),
        "user_id",
        F.struct(
            F.when(churned, "churned").otherwise("active").alias("text"),
            F.col("current_churned_status").alias("code"),
        ).alias("status"),
        F.struct(
            "avg_churn_risk", "max_churn_risk", "days_high_risk", "avg_engagement", "engagement_trend",
            F.format_string("%+.1f", "engagement_trend").alias("engagement_trend_formatted"),
        ).alias("metrics"),
        "recommendations",
    )


def detailed_report(forecast: DataFrame, recommended: DataFrame, as_of: date, n: int = 5) -> DataFrame:
    """One row with four nested sections; ``json_rows`` turns it into a document."""
    users = detailed_users(recommended, n).agg(
        F.array_sort(F.collect_list(F.struct("rank", "user_id", "status", "metrics", "recommendations")))
    )
    bands = risk_bands(recommended).agg(F.collect_list(F.struct("band", "users", "percentage")))
    status = status_counts(recommended).agg(
        F.array_sort(F.collect_list(F.struct(F.col("current_churned_status").alias("status"), F.col("users"))))
    )
    totals = forecast_totals(forecast)
    one_row = totals.select(
        users.scalar().alias("intervention_recommendations"),
        F.struct(
            status.scalar().alias("users_by_status"),
            F.col("users_analyzed").alias("total_users"),
            bands.scalar().alias("risk_distribution"),
        ).alias("risk_summary"),
        F.struct(*totals.columns).alias("model_statistics"),
    )
    return one_row.withColumn("metadata", F.struct(
        F.lit(as_of.isoformat()).alias("generated_at"),
        F.size("intervention_recommendations").alias("total_users_in_report"),
        F.lit("detailed_intervention_report").alias("report_type"),
    ))


def chart_lines(forecast: DataFrame, n: int = 5, users: DataFrame | None = None) -> DataFrame:
    """Daily risk, engagement, sessions and quizzes of the first ``n`` users by key.

    ``users``, one row for each user of the forecast, saves a second pass over a lazy forecast."""
    keys = forecast.select("user_key").distinct() if users is None else users.select("user_key")
    chosen = keys.orderBy("user_key").limit(n)
    return forecast.join(F.broadcast(chosen), "user_key", "left_semi").select(
        "user_key", "user_id", "prediction_day", "predicted_churn_risk",
        "predicted_engagement_score", "predicted_sessions_count", "predicted_quiz_attempts",
    )


def chart_sets(
    forecast: DataFrame | None = None,
    risk: DataFrame | None = None,
    users: DataFrame | None = None,
    correlated: DataFrame | None = None,
    importance: DataFrame | None = None,
    scores: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Data of every chart whose input is given."""
    sets: dict[str, DataFrame] = {}
    if forecast is not None:
        sets["future_predictions"] = chart_lines(forecast, users=users)
    if users is not None:
        sets["churn_distribution"] = label_stats(users)
    if correlated is not None:
        sets["correlations"] = correlated.limit(15)
    if importance is not None:
        sets["feature_importance"] = importance.limit(10)
    if risk is not None:
        sets["risk_distribution"] = risk_bands(risk)
    if scores is not None:
        totals = threshold_totals(scores)
        sets["roc_curve"] = roc_points(totals, corners_only=True)
        sets["precision_recall_curve"] = pr_points(totals)
        sets["curve_areas"] = curve_areas(totals)
    return sets
