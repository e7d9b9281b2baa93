"""Thresholds at, below and above their limits."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ebbtide.operators.actions import LIVE, actions
from ebbtide.operators.labels import choose_labels, label_base, label_realistic
from ebbtide.operators.risk import forecast_table, high_risk, risk_bands, risk_summary, user_risk
from ebbtide.operators.rollup import user_rollup
from ebbtide.operators.series import METRICS
from ebbtide.settings import Settings
from ebbtide.sources.star import ACTIVITY, ENGAGEMENT, USERS, Star

AS_OF = date(2024, 1, 31)


def star(spark, users, activity=(), engagement=()):
    return Star(
        spark.createDataFrame(list(users), USERS),
        spark.createDataFrame(list(activity), ACTIVITY),
        spark.createDataFrame(list(engagement), ENGAGEMENT),
    )


def user(key, status="active", registered=AS_OF, age=20):
    return (key, f"u{key}", None, age, status, True, registered)


def login(key, days, score=80.0, stagnation=0):
    return (key, score, days, 1, 2, 60.0, 60.0, stagnation)


def active(key, days_ago=0, sessions=10):
    return (key, 12.0, sessions, AS_OF - timedelta(days=days_ago), 4, 2, 1, 3, 1)


def test_fanout_multiplies_sums_only(spark):
    data = star(spark, [user(1), user(2), user(3)], [active(1), active(1, 3), active(2)],
                [login(1, 1), login(1, 2), login(1, 3), login(3, 1)])
    compat = {r.user_key: r for r in user_rollup(data).collect()}
    corrected = {r.user_key: r for r in user_rollup(data, "corrected").collect()}
    assert (compat[1].total_sessions, corrected[1].total_sessions) == (60, 20)
    assert compat[2].total_sessions == corrected[2].total_sessions == 10
    assert compat[3].total_sessions == 0
    assert compat[1].avg_session_duration == corrected[1].avg_session_duration == 12.0
    assert compat[2].days_since_last_login == 15 and compat[2].avg_engagement == 50.0


def test_other_states_are_left_out(spark):
    data = star(spark, [user(1, "deleted"), user(2, "pending")])
    assert [r.user_key for r in user_rollup(data).collect()] == [2]


@pytest.mark.parametrize("days_ago,days_login,score,sessions,stagnation,status,expected", [
    (14, 0, 80.0, 10, 0, "active", 0), (15, 0, 80.0, 10, 0, "active", 1),
    (0, 14, 80.0, 10, 0, "active", 0), (0, 15, 80.0, 10, 0, "active", 1),
    (0, 0, 80.0, 10, 0, "suspended", 1),
    (0, 10, 29.0, 10, 0, "active", 0), (0, 11, 29.0, 10, 0, "active", 1), (0, 11, 30.0, 10, 0, "active", 0),
    (0, 7, 80.0, 4, 0, "active", 0), (0, 8, 80.0, 4, 0, "active", 1), (0, 8, 80.0, 5, 0, "active", 0),
    (0, 0, 80.0, 10, 20, "active", 0), (0, 0, 80.0, 10, 21, "active", 1),
])
def test_base_label(spark, days_ago, days_login, score, sessions, stagnation, status, expected):
    data = star(spark, [user(1, status)], [active(1, days_ago, sessions)], [login(1, days_login, score, stagnation)])
    assert label_base(user_rollup(data), AS_OF).first().churned == expected


def test_missing_dates(spark):
    rollup = user_rollup(star(spark, [user(1, registered=None, age=None)], [], [login(1, 0)]))
    base = label_base(rollup, AS_OF).first()
    assert (base.churned, base.days_since_last_activity, base.age) == (1, 30, 13)
    realistic = label_realistic(rollup, AS_OF).first()
    assert (realistic.churned_realistic, realistic.risk_category, realistic.age) == (0, "active", None)


@pytest.mark.parametrize("days_ago,sessions,score,label,category", [
    (30, 10, 80.0, 0, "high_risk"), (31, 10, 80.0, 1, "high_risk"), (21, 10, 80.0, 0, "medium_risk"),
    (22, 10, 80.0, 0, "high_risk"), (14, 10, 80.0, 0, "active"), (15, 10, 80.0, 0, "medium_risk"),
    (0, 2, 24.0, 1, "low_engagement"), (0, 3, 24.0, 0, "low_engagement"), (0, 2, 25.0, 0, "low_engagement"),
    (0, 4, 29.0, 0, "low_engagement"), (0, 5, 29.0, 0, "active"), (0, 4, 30.0, 0, "active"),
])
def test_realistic_label(spark, days_ago, sessions, score, label, category):
    data = star(spark, [user(1)], [active(1, days_ago, sessions)], [login(1, 0, score)])
    row = label_realistic(user_rollup(data), AS_OF).first()
    assert (row.churned_realistic, row.risk_category) == (label, category)


def test_few_positives_switch_to_noise(spark):
    data = star(spark, [user(k) for k in range(40)], [active(k) for k in range(40)], [login(k, 0) for k in range(40)])
    rollup, settings = user_rollup(data), Settings(as_of=AS_OF)
    chosen, approach = choose_labels(label_base(rollup, AS_OF), label_realistic(rollup, AS_OF), settings)
    assert approach == "noisy"
    assert chosen.agg(F.sum("churned")).first()[0] == 2  # 5 % of 40 flipped, all were 0


def forecast_of(spark, days, status=0, key=1):
    """``days``: per day (login, engagement, sessions, quizzes)."""
    base = dict.fromkeys(METRICS, 1.0)
    rows = [
        (key, d + 1, *{**base, "days_since_login": float(a), "engagement_score": float(b),
                       "sessions_count": float(c), "quiz_attempts": float(q)}.values())
        for d, (a, b, c, q) in enumerate(days)
    ]
    predicted = spark.createDataFrame(rows, ["user_key", "horizon_day", *METRICS])
    users = spark.createDataFrame([(key, f"u{key}", status)], "user_key long, user_id string, churned int")
    return forecast_table(predicted, users, AS_OF)


@pytest.mark.parametrize("day,tenths", [
    ((3, 50, 1, 1), 0), ((3.1, 50, 1, 1), 2), ((7, 50, 1, 1), 2), ((7.1, 50, 1, 1), 4),
    ((0, 49.9, 1, 1), 1), ((0, 30, 1, 1), 1), ((0, 29.9, 1, 1), 3), ((0, 50, 0, 1), 2), ((0, 50, 1, 0), 1),
    ((8, 0, 0, 0), 10),
])
def test_day_risk(spark, day, tenths):
    assert forecast_of(spark, [day]).first().risk_tenths == tenths


def test_nan_and_negative_forecasts_are_floored(spark):
    row = forecast_of(spark, [(0, float("nan"), -1, 1)]).first()
    assert row.predicted_engagement_score == 0.0 and row.predicted_sessions_count == 0.0


def test_published_risk_floor(spark):
    """With days_since_login = 16 - d and nothing else, the mean risk is 4/15; engagement
    just under 50 on five days makes it exactly 0.3, which is still the low band."""
    plain = [(16 - d, 50, 1, 1) for d in range(1, 16)]
    assert user_risk(forecast_of(spark, plain)).first().avg_churn_risk == pytest.approx(4 / 15)
    edge = [(16 - d, 49 if d <= 5 else 50, 1, 1) for d in range(1, 16)]
    risk = user_risk(forecast_of(spark, edge))
    assert risk.first().avg_churn_risk == pytest.approx(0.3)
    assert {r.band: r.users for r in risk_bands(risk).collect()} == {"low": 1, "medium": 0, "high": 0}
    over = [(16 - d, 49 if d <= 6 else 50, 1, 1) for d in range(1, 16)]
    assert risk_summary(user_risk(forecast_of(spark, over))).first().medium_users == 1


def test_zero_risk_is_in_no_band_but_in_the_summary(spark):
    risk = user_risk(forecast_of(spark, [(0, 80, 1, 1)] * 15))
    assert sum(r.users for r in risk_bands(risk).collect()) == 0
    assert risk_summary(risk).first().low_users == 1


def listed(spark, rules="live", **values):
    row = {"current_churned_status": 0, "risk_sum": 0, "days": 10, "avg_engagement": 60.0, "engagement_trend": 0.0,
           "low_activity_days": 0, "low_quiz_days": 0, "avg_churn_risk": 0.0, **values}
    return actions(spark.createDataFrame([row]), rules).first().recommendations


@pytest.mark.parametrize("values,rules", [
    ({"current_churned_status": 1, "risk_sum": 90}, ["churned"]),
    ({"risk_sum": 71}, ["critical"]), ({"risk_sum": 70}, ["high"]), ({"risk_sum": 50}, ["moderate"]),
    ({"risk_sum": 30}, ["stable"]),
    ({"avg_engagement": 29.9}, ["stable", "engagement_low"]), ({"avg_engagement": 30.0}, ["stable", "engagement_fair"]),
    ({"avg_engagement": 50.0}, ["stable"]),
    ({"engagement_trend": -10.1}, ["stable", "falling"]), ({"engagement_trend": -10.0}, ["stable"]),
    ({"engagement_trend": 10.1}, ["stable", "rising"]), ({"engagement_trend": 10.0}, ["stable"]),
    ({"low_activity_days": 8}, ["stable", "idle"]), ({"low_activity_days": 7}, ["stable"]),
    ({"low_quiz_days": 6}, ["stable", "few_quizzes"]), ({"low_quiz_days": 5}, ["stable"]),
])
def test_live_actions(spark, values, rules):
    assert listed(spark, **values) == [code for rule in rules for code in LIVE[rule]]


def test_classic_rules_do_not_stop_and_have_no_stable_tier(spark):
    codes = listed(spark, "classic", current_churned_status=1, risk_sum=80, low_quiz_days=15)
    assert codes == LIVE["churned"][:3] + LIVE["critical"][:3]
    assert listed(spark, "classic") == []


def test_tier_rules(spark):
    assert listed(spark, "tiers", risk_sum=71) == ["critical/mail", "critical/call", "critical/offer"]
    assert listed(spark, "tiers", risk_sum=30) == ["stable/mail", "stable/call", "stable/offer"]


def test_any_decimal_threshold(spark):
    risk = spark.createDataFrame([(1, 12, 16, 0.075), (2, 100, 15, 0.6667)], "user_key long, risk_sum long, days long, avg_churn_risk double")
    assert [r.user_key for r in high_risk(risk, 0.075).collect()] == [2]
    assert [r.user_key for r in high_risk(risk, 0.0749).collect()] == [2, 1]


def test_history_must_be_twice_the_horizon():
    with pytest.raises(ValueError):
        Settings(as_of=AS_OF, history_days=31)
