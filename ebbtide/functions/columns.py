"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(as_of: date) -> Column:
    return F.lit(as_of).cast("date")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division where a zero denominator counts as 1 and a null one stays null."""
    bottom = F.when(denominator == 0, F.lit(1.0)).otherwise(denominator.cast("double"))
    return numerator.cast("double") / bottom


def number(value: Column) -> Column:
    """``value`` as double, with NaN as null, which is how pandas aggregates treat it."""
    x = value.cast("double")
    return F.when(~F.isnan(x), x)


def is_positive(value: Column) -> Column:
    """1 when above zero, else 0; null and NaN count as 0."""
    return F.coalesce((number(value) > 0).cast("int"), F.lit(0))


def clamp(value: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        value = F.greatest(F.lit(float(low)), value)
    if high is not None:
        value = F.least(F.lit(float(high)), value)
    return value


def share(part: Column, whole: Column) -> Column:
    """Percentage, 0 when the whole is empty."""
    return F.coalesce(100.0 * part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def rows(structs: Iterable[Column]) -> Column:
    """Turn one wide row into several: the inverse of a pivot, without a shuffle."""
    return F.inline(F.array(*structs))
