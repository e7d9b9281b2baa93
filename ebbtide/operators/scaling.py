"""Standard and min-max scaling, with the inverse that Spark's scalers lack."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.columns import number


@dataclass(frozen=True)
class Scaler:
    """``(x - offset) / width`` per column; a width of zero counts as one."""

    offset: dict[str, float]
    width: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (F.col(c) - F.lit(self.offset[c])) / F.lit(self.width[c]) for c in self.offset
        })

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: F.col(c) * F.lit(self.width[c]) + F.lit(self.offset[c]) for c in self.offset
        })


def _fit(df: DataFrame, columns: list[str], offset, width) -> Scaler:
    one = df.agg(
        *[offset(number(F.col(c))).alias(f"o_{c}") for c in columns],
        *[width(number(F.col(c))).alias(f"w_{c}") for c in columns],
    ).first()
    return Scaler({c: one[f"o_{c}"] or 0.0 for c in columns}, {c: one[f"w_{c}"] or 1.0 for c in columns})


def fit_standard(df: DataFrame, columns: list[str]) -> Scaler:
    """Mean and population deviation; a constant column is only centred."""
    return _fit(df, columns, F.avg, F.stddev_pop)


def fit_min_max(df: DataFrame, columns: list[str]) -> Scaler:
    """Minimum and range; a constant column becomes zero."""
    return _fit(df, columns, F.min, lambda x: F.max(x) - F.min(x))
