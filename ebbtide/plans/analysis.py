"""The whole analysis: from the star schema to the final summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.actions import actions
from ebbtide.operators.classifier import cv_auc, fit_classifier, importances, score
from ebbtide.operators.curves import curve_areas, threshold_totals
from ebbtide.operators.diagnosis import diagnose, regression_error
from ebbtide.operators.features import SAFE_FEATURES, derived_features, impute, safe_features
from ebbtide.operators.forecaster import Forecaster, fit_forecaster, forecast_cells
from ebbtide.operators.labels import choose_labels, label_base, label_rate, label_realistic, label_stats
from ebbtide.operators.profile import correlations, null_counts, numeric_profile, screen
from ebbtide.operators.reports import chart_sets, top_recommendations
from ebbtide.operators.risk import forecast_table, risk_bands, risk_summary, user_risk
from ebbtide.operators.rollup import user_rollup
from ebbtide.operators.scaling import Scaler, fit_standard
from ebbtide.operators.series import daily_series, series_features
from ebbtide.operators.split import split_series, stratified_split
from ebbtide.session import durable, spread
from ebbtide.settings import Settings
from ebbtide.sources.model_store import State
from ebbtide.sources.star import Star


@dataclass(frozen=True)
class Prepared:
    users: DataFrame
    approach: str
    correlated: DataFrame
    selected: list[str]
    profile: dict[str, DataFrame]


@dataclass(frozen=True)
class Classified:
    model: PipelineModel
    scaler: Scaler
    scores: DataFrame
    importance: DataFrame
    cv: tuple[float, float] | None


@dataclass(frozen=True)
class Results:
    """Every step of the analysis; frames are lazy but for what several steps read."""

    prepared: Prepared
    classified: Classified
    diagnosis: DataFrame
    forecaster: Forecaster
    split: DataFrame
    error: DataFrame
    forecast: DataFrame
    risk: DataFrame
    recommended: DataFrame
    top_recommended: DataFrame
    report: DataFrame
    charts: dict[str, DataFrame]
    summary: DataFrame
    state: State


def prepare(star: Star, settings: Settings, fanout: str = "compat") -> Prepared:
    """Roll up, label, impute, derive and screen. The roll-up and the prepared users are
    written out, because several steps read them and the facts are far larger.

    ``profile`` holds the statistics of the extracted users and of their labels before and
    after the labels are chosen, with the number of labels that noise has flipped."""
    rollup = durable(user_rollup(star, fanout))
    base = derived_features(label_base(rollup, settings.as_of))
    labelled, approach = choose_labels(base, label_realistic(rollup, settings.as_of), settings)
    users = durable(safe_features(impute(labelled)))
    correlated = correlations(users, SAFE_FEATURES)
    selected = screen(correlated, SAFE_FEATURES, settings.correlation_limit)
    flips = (base.select("user_key", F.col("churned").alias("before")).join(users.select("user_key", "churned"), "user_key")
             .agg(F.count_if(F.col("before") != F.col("churned")).alias("flipped_labels"))
             if approach == "noisy" else rollup.sparkSession.createDataFrame([(0,)], "flipped_labels long"))
    profile = {
        "numbers": numeric_profile(base), "nulls": null_counts(base), "extracted_labels": label_stats(base),
        "labels": label_stats(users), "label_rate": label_rate(users), "flips": flips,
    }
    return Prepared(users, approach, correlated, selected, profile)


def classify(prepared: Prepared, settings: Settings, cross_validate: bool = True) -> Classified:
    """Fit on the training split; score the test split."""
    train, test = stratified_split(prepared.users, "churned", settings.test_share, settings.seed)
    scaler = fit_standard(train, prepared.selected)
    train = durable(scaler.transform(train).select("user_key", "churned", *prepared.selected))
    model = fit_classifier(train, prepared.selected, settings.classifier, settings.seed)
    cv = cv_auc(train, prepared.selected, settings) if cross_validate else None
    scores = durable(score(model, scaler.transform(test), ["user_key", "churned"]))
    return Classified(model, scaler, scores, importances(model, prepared.selected, scores), cv)


def split_sizes(train: DataFrame, held_out: DataFrame) -> DataFrame:
    """Users that the forecaster is fitted on, and users that its error is measured on."""
    users = F.countDistinct("user_key")
    return train.agg(users.alias("train_users")).join(held_out.agg(users.alias("validation_users")), how="cross")


def run(
    star: Star,
    settings: Settings,
    daily: DataFrame,
    fanout: str = "compat",
    mode: str = "per_target",
    cross_validate: bool = True,
    ledger: str | None = None,
) -> Results:
    """The whole analysis. ``daily`` holds one row per user and day with the daily metrics;
    finished forests are looked up and kept under ``ledger``."""
    prepared = prepare(star, settings, fanout)
    classified = classify(prepared, settings, cross_validate)

    series = durable(daily_series(daily, spread(prepared.users), settings.as_of, settings.history_days))
    train, held_out = split_series(series, prepared.users.select("user_key"))
    forecaster = fit_forecaster(train, settings, mode, ledger=ledger)
    forecast = durable(forecast_users(forecaster, series, prepared.users, settings))
    unseen = forecaster.predict(series_features(held_out, settings))
    error = regression_error(forecast_cells(unseen, held_out, settings))

    risk = durable(user_risk(forecast))
    recommended = actions(risk)
    charts = chart_sets(forecast, risk, prepared.users, prepared.correlated, classified.importance, classified.scores)
    return Results(
        prepared, classified, diagnose(classified.scores), forecaster, split_sizes(train, held_out), error, forecast, risk,
        recommended, top_recommendations(recommended), risk_summary(risk), charts,
        final_summary(risk, forecast, classified.scores, error),
        State(prepared.users, series, prepared.correlated, classified.importance, classified.scores, forecaster, classified.model,
              classified.scaler, prepared.selected, prepared.approach, settings.as_of),
    )


@dataclass(frozen=True)
class Scored:
    """What a stored state gives without a fit. The forecast and the risk table are written out."""

    forecast: DataFrame
    risk: DataFrame
    recommended: DataFrame
    charts: dict[str, DataFrame]


def score_state(state: State, settings: Settings) -> Scored:
    """Forecast, risk, actions and chart data of the users in ``state``, by its models."""
    forecast = durable(forecast_users(state.forecaster, state.series, state.users, settings))
    risk = durable(user_risk(forecast))
    charts = chart_sets(forecast, risk, state.users, state.correlated, state.importance, state.scores)
    return Scored(forecast, risk, actions(risk), charts)


def forecast_users(forecaster: Forecaster, series: DataFrame, users: DataFrame, settings: Settings) -> DataFrame:
    """The forecast table of a fitted or loaded model."""
    return forecast_table(forecaster.predict(series_features(series, settings)), users, settings.as_of)


def final_summary(risk: DataFrame, forecast: DataFrame, scores: DataFrame, error: DataFrame) -> DataFrame:
    """One row: users, status, bands, forecast size, classifier AUC and forecast error."""
    bands = risk_bands(risk).agg(*[
        F.max(F.when(F.col("band") == b, F.col(c))).alias(f"{b}_{c}")
        for b in ("low", "medium", "high") for c in ("users", "percentage")
    ])
    named = bands.select(F.struct("*").alias("bands"))
    areas = curve_areas(threshold_totals(scores))
    return risk_summary(risk).select(
        F.col("total_users").alias("total_users_analyzed"),
        "active_users",
        "churned_users",
        named.scalar().alias("risk_distribution"),
        forecast.agg(F.max("prediction_day")).scalar().alias("prediction_days"),
        forecast.agg(F.count("*")).scalar().alias("total_predictions"),
        areas.select("roc_auc").scalar().alias("churn_model_auc"),
        error.select("mae").scalar().alias("future_model_mae"),
        error.select("mse").scalar().alias("future_model_mse"),
        error.select("cells").scalar().alias("validation_cells"),
    )
