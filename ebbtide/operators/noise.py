"""Noise on features and labels, for label sets that are too easy to separate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.columns import clamp, number
from ebbtide.functions.draws import normal, uniform
from ebbtide.operators.order_stats import cuts_passed

# Noisy columns; the first three are percentages, the rest only have a floor.
PERCENTAGES = ["quiz_accuracy", "challenge_completion", "avg_engagement"]
FLOORED = ["avg_session_duration", "total_sessions"]


def add_noise(df: DataFrame, level: float, seed: int, key: str = "user_key") -> DataFrame:
    """Add normal noise with ``level`` times the column's sample deviation."""
    columns = [c for c in PERCENTAGES + FLOORED if c in df.columns]
    spread = df.agg(*[F.stddev_samp(number(F.col(c))).alias(c) for c in columns]).first()
    noisy = {}
    for c in columns:
        draw = normal([F.col(key)], f"noise:{c}:{seed}")
        value = F.col(c) + F.lit((spread[c] or 0.0) * level) * draw
        noisy[c] = clamp(value, low=0, high=100 if c in PERCENTAGES else None)
    return df.withColumns(noisy)


def flip_labels(
    df: DataFrame, rate: float, seed: int, label: str = "churned", key: str = "user_key", mode: str = "exact"
) -> DataFrame:
    """Flip ``int(rate * n)`` labels (``exact``), or each with probability ``rate`` (``approx``)."""
    salt = f"flip:{seed}"
    if mode == "approx":
        flipped = uniform([F.col(key)], salt) < rate
        return df.withColumn(label, F.when(flipped, 1 - F.col(label)).otherwise(F.col(label)))
    marked = cuts_passed(
        df, key, salt, None, lambda n: F.array(F.floor(n * F.lit(rate))), "cuts_before"
    )
    return marked.withColumn(
        label, F.when(F.col("cuts_before") == 0, 1 - F.col(label)).otherwise(F.col(label))
    ).drop("cuts_before")
