"""Profile of a table: null counts, numeric summary, correlation with the label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions.columns import number, rows
from ebbtide.operators.order_stats import exact_quantiles


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column: how many values are null."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counted.select(
        rows(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in df.columns)
    )


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of each numeric column."""
    columns = columns or numeric_columns(df)
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    measures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*[f(number(F.col(c))).alias(f"{m}_{c}") for c in columns for m, f in measures.items()])

    def row(c: str):
        quarter = [F.lit(q).cast("double") for q in (quartiles[c] or [None] * 3)]
        return F.struct(
            F.lit(c).alias("column_name"),
            *[F.col(f"{m}_{c}").alias(m) for m in ("count", "mean", "std", "min")],
            *[q.alias(name) for q, name in zip(quarter, ("p25", "p50", "p75"))],
            F.col(f"max_{c}").alias("max"),
        )

    return wide.select(rows(row(c) for c in columns))


def correlations(df: DataFrame, columns: list[str], label: str = "churned") -> DataFrame:
    """Pearson correlation of each column with the label, strongest first.

    Pairs with a null side are left out per column. A constant side has no correlation;
    it gives null and sorts last.
    """
    clean = df.select(*[number(F.col(c)).alias(c) for c in columns], number(F.col(label)).alias("_label"))
    aggregates = []
    for c in columns:
        # The deviations must cover the same pairs as the covariance.
        x, y = f"CASE WHEN _label IS NOT NULL THEN {c} END", f"CASE WHEN {c} IS NOT NULL THEN _label END"
        aggregates += [f"covar_pop({c}, _label) AS cov_{c}", f"stddev_pop({x}) * stddev_pop({y}) AS dev_{c}"]
    wide = clean.agg(*[F.expr(a) for a in aggregates])
    pairs = wide.select(rows(
        F.struct(
            F.lit(c).alias("feature"),
            F.when(F.col(f"dev_{c}") >= 1e-12, F.col(f"cov_{c}") / F.col(f"dev_{c}")).alias("correlation"),
        )
        for c in columns
    ))
    return pairs.orderBy(F.abs("correlation").desc_nulls_last(), "feature")


def screen(correlated: DataFrame, candidates: list[str], limit: float = 0.7) -> list[str]:
    """Names, in candidate order, whose correlation is absent or within the limit."""
    dropped = {r["feature"] for r in correlated.where(F.abs("correlation") > limit).collect()}
    return [c for c in candidates if c not in dropped]
