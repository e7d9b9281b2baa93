"""Model steps with small forests: invariants, repeatability, saved state, sinks."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ebbtide.operators.classifier import class_weights, cv_auc, fit_classifier, importances, score
from ebbtide.operators.curves import curve_areas, threshold_totals
from ebbtide.operators.forecaster import fit_forecaster
from ebbtide.operators.reports import chart_sets, detailed_report
from ebbtide.operators.series import METRICS, daily_series, series_features
from ebbtide.plans.analysis import run
from ebbtide.plans.queries import SETTINGS, Inputs
from ebbtide.settings import ForestSize, Settings
from ebbtide.sources.sinks import csv_frame, json_rows, write_csv, write_json
from ebbtide.sources.star import TABLES, load_star, make_star, run_sql

FOLDER = "/root/testdata/sf0.001"
SMALL = replace(
    SETTINGS, classifier=ForestSize(8, 3, 2, "0.5"), forecaster=ForestSize(3, 2, 1, "all"), folds=2,
)


@pytest.fixture(scope="module")
def given(spark):
    return Inputs(spark, FOLDER)


@pytest.fixture(scope="module")
def results(given):
    return run(given.star, SMALL, given.daily, mode="per_metric")


def test_separable_classes_are_learned(spark):
    df = spark.range(400).select(
        F.col("id").alias("user_key"), (F.col("id") % 4 == 0).cast("int").alias("churned"),
        ((F.col("id") % 4 == 0).cast("double") + F.rand(1)).alias("signal"), F.rand(2).alias("noise"),
    ).cache()
    columns = ["signal", "noise"]
    model = fit_classifier(df, columns, SMALL.classifier, 42)
    scored = score(model, df, ["user_key", "churned"])
    assert curve_areas(threshold_totals(scored)).first().roc_auc > 0.95
    assert scored.where("score < 0 OR score > 1 OR predicted <> cast(score >= 0.5 AS int)").count() == 0
    ranked = importances(model, columns, df).collect()
    assert ranked[0].feature == "signal" and sum(r.importance for r in ranked) == pytest.approx(1.0)
    mean, std = cv_auc(df, columns, SMALL)
    assert mean > 0.9 and std >= 0
    assert {r.churned: r.weight for r in class_weights(df).collect()} == {0: pytest.approx(2 / 3), 1: pytest.approx(2.0)}
    again = score(fit_classifier(df, columns, SMALL.classifier, 42), df, ["user_key"])
    assert scored.select("user_key", "score").exceptAll(again.select("user_key", "score")).count() == 0


def test_full_analysis(results):
    users = results.prepared.users.count()
    assert results.prepared.approach == "realistic" and results.prepared.selected
    assert results.forecast.count() == 15 * users
    assert results.risk.where("max_churn_risk < avg_churn_risk").count() == 0
    sizes = {name: frame.count() for name, frame in results.charts.items()}
    assert sizes["future_predictions"] == 75 and sizes["churn_distribution"] == 2 and sizes["risk_distribution"] == 3
    assert sizes["correlations"] == 15 and sizes["feature_importance"] == min(10, len(results.prepared.selected))
    assert sizes["roc_curve"] >= 2 and sizes["precision_recall_curve"] >= 2 and sizes["curve_areas"] == 1
    first = results.charts["future_predictions"].orderBy("user_key", "prediction_day").first()
    assert first.prediction_day == 1 and 0 <= first.predicted_churn_risk <= 1
    shown = results.charts["feature_importance"].collect()
    assert shown == sorted(shown, key=lambda r: (-r.importance, r.feature))
    summary = results.summary.first()
    assert summary.total_users_analyzed == users == summary.active_users + summary.churned_users
    assert summary.total_predictions == 15 * users and 0 <= summary.churn_model_auc <= 1
    assert summary.future_model_mae >= 0 and summary.validation_cells == 135 * (users - int(0.8 * users))
    assert results.split.first().train_users == int(0.8 * users)
    assert results.diagnosis.first().total == results.classified.scores.count()
    assert results.top_recommended.count() == 20 and results.report.first().total_users == users
    assert results.prepared.profile["flips"].first().flipped_labels == 0
    assert sum(r.users for r in results.prepared.profile["labels"].collect()) == users


def test_chart_sets_skip_missing_inputs():
    assert chart_sets() == {}


def test_per_target_mode(given):
    history = Settings(as_of=SETTINGS.as_of, history_days=4, horizon_days=2, forecaster=SMALL.forecaster)
    users = given.rollup.select("user_key")
    series = daily_series(given.daily, users, SETTINGS.as_of, 4).cache()
    model = fit_forecaster(series, history)
    out = model.predict(series_features(series, history))
    assert out.count() == 2 * users.count() and out.columns == ["user_key", "horizon_day", *METRICS]


def test_sinks(spark, given, tmp_path):
    write_csv(given.recommended, str(tmp_path / "csv"))
    read = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert read.columns == csv_frame(given.recommended).columns and read.count() == given.recommended.count()
    odd = spark.sql("SELECT double('NaN') AS a, DATE '2024-01-02' AS d, CAST(NULL AS int) AS n, TIMESTAMP '2024-01-02 03:04:05' AS t")
    record = json.loads(json_rows(odd).first().json)
    assert record == {"a": None, "d": "2024-01-02", "n": None, "t": "2024-01-02T03:04:05.000000"}
    write_json(odd, str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).count() == 1


def test_detailed_report_document(given):
    report = detailed_report(given.forecast, given.recommended, SETTINGS.as_of)
    document = json.loads(json_rows(report).first().json)
    assert [u["rank"] for u in document["intervention_recommendations"]] == [1, 2, 3, 4, 5]
    assert document["model_statistics"]["predictions_per_user"] == 15
    assert document["metadata"]["generated_at"] == "2024-01-31"


def test_star_round_trip(spark, given, tmp_path):
    for name, frame in zip(TABLES, (given.star.users, given.star.activity, given.star.engagement)):
        frame.write.parquet(str(tmp_path / name))
    star = load_star(spark, str(tmp_path))
    assert run_sql(spark, star, "SELECT * FROM {dim_users}").count() == given.star.users.count()
    with pytest.raises(ValueError):
        make_star(star.users.drop("age"), star.activity, star.engagement)
