"""Spark-native user-churn analytics.

Operators take and return DataFrames, so they chain with ``DataFrame.transform``.
Every date rule is relative to an explicit ``as_of`` day and every random draw is a
keyed hash, so a result depends on its input alone, never on partitioning or retries.
"""

from ebbtide.settings import ForestSize, Settings

__all__ = ["ForestSize", "Settings"]
