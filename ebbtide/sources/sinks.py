"""Outputs: CSV and JSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the recommendation export, in order.
EXPORT_COLUMNS = [
    "user_id", "current_churned_status", "avg_churn_risk", "max_churn_risk",
    "days_high_risk", "avg_engagement", "engagement_trend",
]


def csv_frame(recommended: DataFrame, k: int = 5) -> DataFrame:
    """Metrics, the number of actions and the first ``k`` of them as columns."""
    listed = F.col("recommendations")
    return recommended.select(
        *EXPORT_COLUMNS,
        F.size(listed).alias("total_recommendations"),
        *[F.get(listed, F.lit(i)).alias(f"recommendation_{i + 1}") for i in range(k)],
    )


def write_csv(recommended: DataFrame, path: str, k: int = 5) -> None:
    """One file per partition, each with a header, in a folder."""
    csv_frame(recommended, k).write.mode("overwrite").csv(path, header=True)


def typed(recommended: DataFrame) -> DataFrame:
    """The eight published fields with fixed types."""
    types = ["string", "int", "double", "double", "int", "double", "double"]
    return recommended.select(
        *[F.col(c).cast(t).alias(c) for c, t in zip(EXPORT_COLUMNS, types)],
        F.col("recommendations").cast("array<string>").alias("recommendations"),
    )


def _plain(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        column = F.when(~F.isnan(column), column)
    elif isinstance(field.dataType, T.DateType):
        column = F.date_format(column, "yyyy-MM-dd")
    elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        column = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return column.alias(field.name)


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON document per row: NaN becomes null, nulls are kept, dates are ISO."""
    record = F.struct(*[_plain(f) for f in df.schema])
    return df.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    json_rows(df).write.mode("overwrite").text(path)


def stats_map(counts: DataFrame, key: str, value: str) -> DataFrame:
    """Fold a small count table (a row per class or column) into one string-to-int map."""
    pair = F.struct(F.col(key).cast("string"), F.col(value).cast("int"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("stats"))
