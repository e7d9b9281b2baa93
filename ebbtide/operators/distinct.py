"""Exact distinct counts from bitmaps that can be stored, merged and counted again.

An id sets one bit of the bitmap of its bucket, 32,768 ids to a bitmap. A table of bitmaps is a
state: states of days are merged into months by OR, without going back to the facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_state(df: DataFrame, by: list[str | Column], key: str = "user_key") -> DataFrame:
    """``by``, bucket and bitmap of the values of ``key``, a whole number; null is no value."""
    return df.where(F.col(key).isNotNull()).groupBy(*by, F.bitmap_bucket_number(key).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits")
    )


def merge_distinct(states: DataFrame, by: list[str | Column]) -> DataFrame:
    """The states of coarser groups, or of several tables of states after a union."""
    return states.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def count_distinct(states: DataFrame, by: list[str], name: str = "users") -> DataFrame:
    """One row per group of a state that has one bitmap per group and bucket."""
    return states.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias(name))
