"""Forecast table, day scores and the roll-up per user.

Day risk is kept in whole tenths. Sums of 0.1 steps in floating point land on either side
of the 0.3 and 0.7 limits depending on their order; integers do not.
"""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.columns import rows, share
from ebbtide.operators.series import METRICS

BANDS = ["low", "medium", "high"]


def day_risk() -> Column:
    """Risk of one forecast day in tenths, 0 to 10."""
    login, engagement = F.col("predicted_days_since_login"), F.col("predicted_engagement_score")
    points = (
        F.when(login > 7, 4).when(login > 3, 2).otherwise(0)
        + F.when(engagement < 30, 3).when(engagement < 50, 1).otherwise(0)
        + F.when(F.col("predicted_sessions_count") == 0, 2).otherwise(0)
        + F.when(F.col("predicted_quiz_attempts") == 0, 1).otherwise(0)
    )
    return F.least(F.lit(10), points)


def engagement_level() -> Column:
    score = F.col("predicted_engagement_score")
    return F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def widen_forecast(cells: DataFrame) -> DataFrame:
    """(user_key, horizon_day, metric, y) to one row per user and day.

    One aggregation with a group per row of the result; a pivot would first group by metric too."""
    return cells.groupBy("user_key", "horizon_day").agg(
        *[F.first(F.when(F.col("metric") == m, F.col("y")), ignorenulls=True).alias(m) for m in METRICS]
    )


def forecast_table(predicted: DataFrame, users: DataFrame, as_of: date, label: str = "churned") -> DataFrame:
    """Attach user attributes, dates, day risk and engagement level to predicted metrics.

    ``predicted`` is (user_key, horizon_day, nine metrics). The join is on the key, so a
    user without a forecast cannot shift another one's row.
    """
    attributes = users.select("user_key", "user_id", F.col(label).alias("current_churned_status"))
    named = predicted.join(attributes, "user_key").selectExpr(
        "user_id",
        "user_key",
        "CAST(horizon_day AS int) AS prediction_day",
        f"date_add(DATE '{as_of}', CAST(horizon_day AS int)) AS predicted_date",
        "current_churned_status",
        # greatest() alone would keep a NaN.
        *[f"greatest(0D, nanvl({m}, 0D)) AS predicted_{m}" for m in METRICS],
    )
    return named.withColumn("risk_tenths", day_risk()).withColumns({
        "predicted_churn_risk": F.col("risk_tenths") / 10.0,
        "predicted_engagement_level": engagement_level(),
    })


def user_risk(forecast: DataFrame, high_day: int = 7) -> DataFrame:
    """One row per user with a forecast. Days of more than ``high_day`` tenths count as high risk;
    the tiers-only rules take 6."""
    score, on = "predicted_engagement_score", "prediction_day"
    per_user = forecast.groupBy("user_key", "user_id").agg(*[F.expr(e) for e in (
        f"min_by(current_churned_status, {on}) AS current_churned_status",
        "count(*) AS days",
        "sum(risk_tenths) AS risk_sum",
        "max(risk_tenths) AS risk_max",
        f"count_if(risk_tenths > {high_day}) AS days_high_risk",
        f"avg({score}) AS avg_engagement",
        f"max_by({score}, {on}) - min_by({score}, {on}) AS engagement_trend",
        "count_if(predicted_sessions_count = 0) AS low_activity_days",
        "count_if(predicted_quiz_attempts = 0) AS low_quiz_days",
    )])
    return per_user.withColumns({
        "avg_churn_risk": F.expr("risk_sum / (10D * days)"),
        "max_churn_risk": F.expr("risk_max / 10D"),
    })


def above(tenths: int | Decimal) -> Column:
    """Mean day risk strictly above ``tenths`` / 10, decided on whole or decimal numbers."""
    return F.col("risk_sum") > F.lit(tenths) * F.col("days")


def ranked(risk: DataFrame, n: int | None = None) -> DataFrame:
    """Riskiest users first; ties by key."""
    ordered = risk.orderBy(F.col("avg_churn_risk").desc(), "user_key")
    return ordered if n is None else ordered.limit(n)


def high_risk(risk: DataFrame, threshold: float = 0.6, n: int | None = None) -> DataFrame:
    """Users whose mean risk is above ``threshold``, riskiest first; any decimal will do."""
    return ranked(risk.where(above(Decimal(str(threshold)) * 10)), n)


def heuristic_risk(users: DataFrame, away_days: int = 7) -> DataFrame:
    """Risk score of users away for more than ``away_days`` days, by rule; it is not capped."""
    away = users.where(F.col("days_since_last_login") > away_days)
    return away.withColumn(
        "risk_score", 0.3 + F.col("days_since_last_login") / 30.0 * 0.4 + (100 - F.col("avg_engagement")) / 100.0 * 0.3
    )


def by_status(risk: DataFrame) -> dict[str, DataFrame]:
    status = F.col("current_churned_status")
    return {"active": risk.where(status == 0), "churned": risk.where(status == 1)}


def status_counts(risk: DataFrame) -> DataFrame:
    """Distinct users per current status; a missing status counts nowhere."""
    return (
        risk.where(F.col("current_churned_status").isNotNull())
        .groupBy("current_churned_status")
        .agg(F.countDistinct("user_id").alias("users"))
    )


def risk_bands(risk: DataFrame) -> DataFrame:
    """Users per right-closed band. A mean risk of exactly zero is in no band, but every
    user counts in the percentages."""
    inside = {
        "low": (F.col("risk_sum") > 0) & ~above(3),
        "medium": above(3) & ~above(6),
        "high": above(6),
    }
    counts = risk.agg(F.count("*").alias("total"), *[F.count_if(inside[b]).alias(b) for b in BANDS])
    return counts.select(rows(
        F.struct(
            F.lit(b).alias("band"), F.col(b).alias("users"), share(F.col(b), F.col("total")).alias("percentage")
        )
        for b in BANDS
    ))


def risk_summary(risk: DataFrame) -> DataFrame:
    """One row of totals. Here the low band does include zero."""
    status = F.col("current_churned_status")
    return risk.agg(
        F.count("*").alias("total_users"),
        F.avg("avg_churn_risk").alias("average_risk"),
        F.count_if(~above(3)).alias("low_users"),
        F.count_if(above(3) & ~above(6)).alias("medium_users"),
        F.count_if(above(6)).alias("high_users"),
        F.count_if(status == 0).alias("active_users"),
        F.count_if(status == 1).alias("churned_users"),
        F.count_if(above(6)).alias("high_risk_users"),
    )


def forecast_totals(forecast: DataFrame) -> DataFrame:
    """Sizes of a forecast, with whole predictions per user."""
    sizes = forecast.agg(
        F.countDistinct("user_key").alias("users_analyzed"),
        F.max("prediction_day").cast("bigint").alias("prediction_days"),
        F.count("*").alias("total_predictions"),
    )
    return sizes.withColumns({
        "metrics_per_day": F.lit(len(METRICS)).cast("bigint"),
        "predictions_per_user": F.coalesce(
            F.floor(F.col("total_predictions") / F.nullif("users_analyzed", F.lit(0))), F.lit(0)
        ),
    })
