"""Intervention actions per user, from a rule table.

An action says which rule asked for it and over which channel it goes out. A rule hands out
its channels in a fixed order, and how many it hands out is what the rule tables state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.risk import above

CHANNELS = ["mail", "call", "offer", "in_app", "coach"]
TIERS = ["critical", "high", "moderate", "stable"]


def _catalogue(counts: dict[str, int]) -> dict[str, list[str]]:
    return {rule: [f"{rule}/{channel}" for channel in CHANNELS[:n]] for rule, n in counts.items()}


# How many actions each rule hands out. Rules apply in this order, which
# decides the five that reach the CSV.
LIVE = _catalogue({
    "churned": 4, "critical": 5, "high": 5, "moderate": 4, "stable": 3, "engagement_low": 4, "engagement_fair": 2,
    "falling": 4, "rising": 2, "idle": 3, "few_quizzes": 3,
})
CLASSIC = _catalogue({
    "churned": 3, "critical": 3, "high": 3, "moderate": 2, "engagement_low": 2, "falling": 2, "idle": 2,
})
TIERS_ONLY = _catalogue({"critical": 3, "high": 3, "moderate": 3, "stable": 3})


def _when(condition: Column, codes: list[str]) -> Column:
    return F.when(condition, F.array(*[F.lit(c) for c in codes])).otherwise(F.array().cast("array<string>"))


def _tier(table: dict[str, list[str]], above: Callable[[int], Column]) -> Column:
    """Exactly one tier by mean risk; ``above(t)`` tests for more than t tenths. A tier
    the table lacks hands out nothing."""
    name = F.when(above(7), "critical").when(above(5), "high").when(above(3), "moderate").otherwise("stable")
    return F.concat(*[_when(name == tier, table[tier]) for tier in TIERS if tier in table])


def _live() -> Column:
    engagement, trend = F.col("avg_engagement"), F.col("engagement_trend")
    rules = F.concat(
        _tier(LIVE, above),
        _when(engagement < 30, LIVE["engagement_low"]),
        _when((engagement >= 30) & (engagement < 50), LIVE["engagement_fair"]),
        _when(trend < -10, LIVE["falling"]),
        _when(trend > 10, LIVE["rising"]),
        _when(F.col("low_activity_days") > 7, LIVE["idle"]),
        _when(F.col("low_quiz_days") > 5, LIVE["few_quizzes"]),
    )
    # A user who has already churned gets the reactivation actions and nothing else.
    churned = F.array(*[F.lit(c) for c in LIVE["churned"]])
    return F.when(F.col("current_churned_status") == 1, churned).otherwise(rules)


def _classic() -> Column:
    return F.concat(
        _when(F.col("current_churned_status") == 1, CLASSIC["churned"]),
        _tier(CLASSIC, above),
        _when(F.col("avg_engagement") < 30, CLASSIC["engagement_low"]),
        _when(F.col("engagement_trend") < -10, CLASSIC["falling"]),
        _when(F.col("low_activity_days") > 7, CLASSIC["idle"]),
    )


def actions(risk: DataFrame, rules: str = "live") -> DataFrame:
    """Add ``recommendations``, an array of action codes in rule order.

    ``live`` is the full table, ``classic`` the older shorter one that does not stop at
    churned users, ``tiers`` the one that looks at mean risk only.
    """
    columns = {"live": _live, "classic": _classic, "tiers": lambda: _tier(TIERS_ONLY, above)}
    return risk.withColumn("recommendations", columns[rules]())


def top_actions(recommended: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent actions; ties by code."""
    return (
        recommended.select(F.explode("recommendations").alias("action"))
        .groupBy("action").agg(F.count("*").alias("users"))
        .orderBy(F.col("users").desc(), "action").limit(n)
    )
