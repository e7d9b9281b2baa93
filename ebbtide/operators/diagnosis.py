"""Diagnosis of scores and of regression error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.columns import share
from ebbtide.operators.order_stats import exact_quantiles


def score_stats(scores: DataFrame, score: str = "score") -> DataFrame:
    """Extremes, mean, population deviation and exact median of the scores."""
    median = exact_quantiles(scores, [score], [0.5])[score]
    return scores.agg(
        F.min(score).alias("min"),
        F.max(score).alias("max"),
        F.avg(score).alias("mean"),
        F.stddev_pop(score).alias("std"),
        F.lit(median[0] if median else None).cast("double").alias("median"),
    )


def overlap_ratio(scores: DataFrame, label: str = "churned", score: str = "score") -> DataFrame:
    """Share of negatives whose score lies in the positives' range; 0 without one class."""
    limits = scores.where(F.col(label) == 1).agg(F.min(score), F.max(score)).first()
    inside = F.col(score).between(F.lit(limits[0]).cast("double"), F.lit(limits[1]).cast("double"))
    return scores.where(F.col(label) == 0).agg(
        F.coalesce(F.avg(F.coalesce(inside.cast("int"), F.lit(0))), F.lit(0.0)).alias("overlap_ratio")
    )


def extreme_scores(scores: DataFrame, score: str = "score") -> DataFrame:
    counts = scores.agg(
        F.count_if(F.col(score) > 0.95).alias("high"),
        F.count_if(F.col(score) < 0.05).alias("low"),
        F.count("*").alias("total"),
    )
    return counts.withColumns({
        "high_percentage": share(F.col("high"), F.col("total")),
        "low_percentage": share(F.col("low"), F.col("total")),
    })


def regression_error(cells: DataFrame, actual: str = "y", predicted: str = "p") -> DataFrame:
    """MAE and MSE over every user, day and metric, in original units."""
    gap = F.col(actual) - F.col(predicted)
    return cells.agg(
        F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse"), F.count("*").alias("cells")
    )


def diagnose(scores: DataFrame, label: str = "churned", score: str = "score") -> DataFrame:
    """One row: score statistics, class overlap and extreme scores. Building it runs jobs."""
    joined = score_stats(scores, score)
    for part in (overlap_ratio(scores, label, score), extreme_scores(scores, score)):
        # One row each.
        joined = joined.join(part, how="cross")
    return joined
