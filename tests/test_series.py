"""Daily series, features and the straight-line forecast."""

from datetime import date, timedelta
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.operators.risk import widen_forecast
from ebbtide.operators.series import (
    COUNTED, FEATURES, METRICS, daily_series, series_features, series_targets, trend_forecast,
)
from ebbtide.plans.queries import Inputs
from ebbtide.settings import Settings

AS_OF = date(2024, 1, 31)
SETTINGS = Settings(as_of=AS_OF)


def daily(spark, rows):
    """rows: (user, days ago, sessions)."""
    return spark.createDataFrame(
        [(u, AS_OF - timedelta(days=d), 5.0, n, 40.0, 2, 1, 0, 0) for u, d, n in rows],
        "user_key long, metric_date date, session_duration double, sessions_count long, engagement_score double,"
        " quiz_attempts long, quiz_completions long, content_views long, challenge_interactions long",
    )


def test_dense_series_and_streaks(spark):
    rows = [(1, 30, 1), (1, 29, 1), (1, 27, 1), (1, 1, 3), (1, 31, 9), (1, 0, 9)]
    users = spark.createDataFrame([(1,), (2,)], "user_key long")
    out = daily_series(daily(spark, rows), users, AS_OF).orderBy("user_key", "day_offset").collect()
    assert len(out) == 60
    first, second = out[:30], out[30:]
    assert [r.login_streak for r in first[:5]] == [1, 2, 0, 1, 0]
    assert [r.days_since_login for r in first[:5]] == [0, 0, 1, 0, 1]
    assert first[-1].sessions_count == 3 and sum(r.sessions_count for r in first) == 6
    assert {r.days_since_login for r in second} == {30.0} and {r.login_streak for r in second} == {0.0}


def test_features_match_numpy(spark):
    rows = [(1, d, d % 4 + 1) for d in range(1, 31) if d % 3]
    series = daily_series(daily(spark, rows), spark.createDataFrame([(1,)], "user_key long"), AS_OF)
    row = series_features(series, SETTINGS).first()
    sessions = [r.sessions_count for r in series.orderBy("day_offset").collect()][:15]
    assert row.sessions_count_mean == pytest.approx(np.mean(sessions))
    assert row.sessions_count_std == pytest.approx(np.std(sessions))
    assert row.sessions_count_last == sessions[-1] and row.sessions_count_sum == sum(sessions)
    assert row.sessions_count_active_days == sum(1 for s in sessions if s > 0)
    slope = np.polyfit(range(15), sessions, 1)[0]
    assert row.sessions_count_slope == pytest.approx(slope)
    assert len(FEATURES) == 72 and row.challenge_interactions_slope == 0.0
    forecast = {r.horizon_day: r.sessions_count for r in trend_forecast(series_features(series, SETTINGS), SETTINGS).collect()}
    for d in (1, 15):
        assert forecast[d] == pytest.approx(max(0, np.mean(sessions) + slope * (7 + d)), abs=1e-6)


def test_short_series_are_skipped_and_targets_round_trip(spark):
    series = daily_series(daily(spark, [(1, 5, 1)]), spark.createDataFrame([(1,), (2,)], "user_key long"), AS_OF)
    assert series_features(series.where("user_key = 1 OR day_offset > -20"), SETTINGS).count() == 1
    targets = series_targets(series, SETTINGS)
    assert targets.count() == 2 * 15 * len(METRICS)
    wide = widen_forecast(targets)
    assert wide.columns == ["user_key", "horizon_day", *METRICS] and wide.count() == 30


def test_days_of_every_pattern_match_a_plain_loop(spark):
    rng = np.random.default_rng(0)
    active = {u: sorted(set(rng.integers(1, 31, rng.integers(0, 30)).tolist()), reverse=True) for u in range(40)}
    frame = daily(spark, [(u, d, 1) for u, days in active.items() for d in days])
    users = spark.range(40).withColumnRenamed("id", "user_key")
    for r in daily_series(frame, users, AS_OF).collect():
        days, streak, since = active[r.user_key], 0, 30
        for d in range(30, -r.day_offset - 1, -1):
            streak, since = (streak + 1, 0) if d in days else (0, since + 1 if since < 30 else 30)
        assert (r.login_streak, r.days_since_login) == (streak, since)


def test_widened_in_one_aggregation(spark):
    cells = spark.createDataFrame(
        [(1, 1, "quiz_attempts", 2.0), (1, 1, "login_streak", None), (1, 2, "unknown", 3.0), (None, 1, "quiz_attempts", 0.0)],
        "user_key long, horizon_day int, metric string, y double",
    )
    wide = widen_forecast(cells)
    assert wide.columns == ["user_key", "horizon_day", *METRICS]
    assert {(r.user_key, r.horizon_day): (r.quiz_attempts, r.login_streak) for r in wide.collect()} == {
        (1, 1): (2.0, None), (1, 2): (None, None), (None, 1): (0.0, None),
    }
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_days_are_spread_before_they_multiply(spark):
    given = Inputs(spark, "")
    users = spark.range(400).selectExpr("id AS user_key", "'active' AS account_status")
    metrics = [F.lit(1.0).alias(m) for m in COUNTED]
    given.__dict__["star"] = SimpleNamespace(users=users)
    given.__dict__["window"] = users.select("user_key", F.date_sub(F.lit(SETTINGS.as_of), 3).alias("metric_date"), *metrics)
    parts = given.series.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in parts) < 400 * 30 / 2
