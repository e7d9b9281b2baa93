"""Named queries over the driver tables: one or more per operator.

Each takes (spark, folder) and returns a DataFrame over whole tables. Published doubles
are rounded to eight decimals, because the order of a distributed sum is not fixed.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.operators import actions as act
from ebbtide.operators import classifier, curves, diagnosis, distinct, labels, profile, reports, risk, scaling, split
from ebbtide.operators import features as feats
from ebbtide.operators import noise as noisy
from ebbtide.operators import series as ser
from ebbtide.operators.forecaster import fit_forecaster, forecast_cells
from ebbtide.operators.rollup import KEPT_STATUS, user_rollup
from ebbtide.plans import analysis
from ebbtide.session import durable, shared_folder, spread
from ebbtide.settings import ForestSize, Settings
from ebbtide.sources import driver_tables as tables
from ebbtide.sources import sinks
from ebbtide.sources.bucketed import bucketed_star, store_star, write_bucketed
from ebbtide.sources.increments import RollupStore
from ebbtide.sources.model_store import ModelStore
from ebbtide.sources.star import Star, run_sql

SETTINGS = Settings(as_of=tables.AS_OF)
# Small forests for the forecaster alone: 135 of the default size take 225 s on a thousand users.
QUICK = replace(SETTINGS, forecaster=ForestSize(4, 3, 2, "all"))
#: Buckets of the queries that store tables by user.
BUCKETS = 16
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[function.__name__] = lambda spark, folder: function(Inputs(spark, folder))
    return function


def publish(df: DataFrame, digits: int = 8) -> DataFrame:
    """Rounded doubles. The nudge moves exact ties off the boundary, where the last bit of
    a sum would decide the result."""
    return df.selectExpr(*[
        f"round(`{f.name}` + 1e-11D, {digits}) AS `{f.name}`" if isinstance(f.dataType, T.DoubleType) else f"`{f.name}`"
        for f in df.schema
    ])


def codes(df: DataFrame) -> DataFrame:
    """Action arrays as one comma-separated string."""
    return df.withColumn("recommendations", F.array_join("recommendations", ","))


# --- shared inputs ----------------------------------------------------------------

class Inputs:
    """Intermediate frames of one query, each built once."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    @cached_property
    def activity(self) -> DataFrame:
        return tables.daily_activity(self.spark, self.folder)

    @cached_property
    def star(self) -> Star:
        return tables.driver_star(self.spark, self.folder, SETTINGS.as_of, self.activity)

    @cached_property
    def daily(self) -> DataFrame:
        return tables.daily_metrics(self.activity)

    @cached_property
    def rollup(self) -> DataFrame:
        return user_rollup(self.star)

    @cached_property
    def base(self) -> DataFrame:
        return labels.label_base(self.rollup, SETTINGS.as_of)

    @cached_property
    def derived(self) -> DataFrame:
        return feats.derived_features(self.base)

    @cached_property
    def realistic(self) -> DataFrame:
        return labels.label_realistic(self.rollup, SETTINGS.as_of)

    @cached_property
    def model_users(self) -> DataFrame:
        """Realistic users with ``churned`` as the label name, before imputation."""
        return self.realistic.withColumnRenamed("churned_realistic", "churned")

    @cached_property
    def safe(self) -> DataFrame:
        return feats.safe_features(feats.impute(self.model_users))

    @cached_property
    def series(self) -> DataFrame:
        users = self.rollup if "rollup" in self.__dict__ else self.star.users.where(F.col("account_status").isin(KEPT_STATUS))
        daily = self.daily if "rollup" in self.__dict__ else self.window
        # The days of a user are many more than the bytes of its row, by which adaptive execution merges.
        return ser.daily_series(daily, spread(users), SETTINGS.as_of, SETTINGS.history_days)

    @cached_property
    def targets(self) -> DataFrame:
        return ser.second_half(self.series, SETTINGS)

    @cached_property
    def trend(self) -> DataFrame:
        return ser.trend_forecast(ser.series_features(self.series, SETTINGS), SETTINGS)

    @cached_property
    def forecast(self) -> DataFrame:
        return risk.forecast_table(self.trend, self.model_users, SETTINGS.as_of)

    @cached_property
    def risk(self) -> DataFrame:
        return risk.user_risk(self.forecast)

    @cached_property
    def recommended(self) -> DataFrame:
        return act.actions(self.risk)

    @cached_property
    def scores(self) -> DataFrame:
        """A deterministic score table: the inactivity heuristic against realistic labels."""
        heuristic = "least(1D, (days_since_last_login / 30D * 0.4D + (100 - avg_engagement) / 100 * 0.3D) * 2)"
        return durable(self.rollup.select(
            "user_key",
            labels.realistic_churn(SETTINGS.as_of).alias("churned"),
            F.expr(f"round({heuristic} + 1e-11D, 8)").alias("score"),
        ))

    @cached_property
    def totals(self) -> DataFrame:
        return curves.threshold_totals(self.scores)

    @cached_property
    def kept(self) -> Inputs:
        """The same inputs with the daily table and the roll-up written once: every input table
        is read once, and whatever follows reads these two."""
        other = Inputs(self.spark, self.folder)
        other.__dict__["activity"] = durable(self.activity)
        other.__dict__["rollup"] = durable(other.rollup)
        return other

    @cached_property
    def reported(self) -> Inputs:
        """``kept`` with the forecast and the risk table written too, for reports over both."""
        other = self.kept
        other.__dict__["forecast"] = durable(other.forecast)
        other.__dict__["risk"] = durable(other.risk)
        return other

    @cached_property
    def window(self) -> DataFrame:
        """Daily metrics of the window alone; its bounds reach the scan of the events."""
        first, last = SETTINGS.as_of - timedelta(days=SETTINGS.history_days), SETTINGS.as_of - timedelta(days=1)
        return tables.daily_metrics(tables.daily_activity(self.spark, self.folder, first, last))

    @cached_property
    def scored(self) -> analysis.Scored:
        """By the newest model of these tables and settings; the first query that asks fits and publishes one."""
        mark = hashlib.sha256(repr(QUICK).encode()).hexdigest()[:16]
        store = ModelStore(self.spark, f"{shared_folder(self.spark)}/models-{tables.tables_mark(self.spark, self.folder)}-{mark}")
        if not store.versions():
            ready = self.kept
            store.save(analysis.run(ready.star, QUICK, ready.daily, cross_validate=False).state)
        return analysis.score_state(store.load(), QUICK)

    @cached_property
    def prepared(self) -> analysis.Prepared:
        return analysis.prepare(self.star, SETTINGS)


# --- sources and roll-up ----------------------------------------------------------

@query
def sql_sessions_by_status(given):
    return publish(run_sql(given.spark, given.star, """
        SELECT u.account_status, count(DISTINCT u.user_key) AS users, sum(a.session_count) AS sessions,
               avg(a.avg_session_duration) AS mean_duration
        FROM {dim_users} u LEFT JOIN {fact_user_activity} a ON u.user_key = a.user_key
        GROUP BY u.account_status
    """))


@query
def scan_users(given):
    return given.star.users.drop("email")


@query
def scan_activity(given):
    return publish(given.star.activity)


@query
def scan_engagement(given):
    return publish(given.star.engagement)


@query
def user_rollup_corrected(given):
    return publish(user_rollup(given.star, "corrected").drop("email"))


@query
def user_rollup_incremental(given):
    """The roll-up from partial states of four loads, the older ones merged."""
    store = RollupStore(given.spark, f"{shared_folder(given.spark)}/states-{uuid.uuid4().hex}")
    days = [SETTINGS.as_of - timedelta(days=d) for d in (60, 30, 1)]
    seen, star = F.col("last_activity_date"), given.star
    for since, until in zip([None, *days], [*days, None]):
        load = star.activity if since is None else star.activity.where(seen > F.lit(since))
        store.append(until or SETTINGS.as_of, activity=load if until is None else load.where(seen <= F.lit(until)))
    store.append(days[0], engagement=star.engagement.where(F.pmod("user_key", F.lit(2)) == 0))
    store.append(SETTINGS.as_of, engagement=star.engagement.where(F.pmod("user_key", F.lit(2)) == 1))
    store.merge(days[1])
    return publish(store.rollup(star.users, "corrected").drop("email"))


@query
def user_rollup_bucketed(given):
    """The roll-up over tables in buckets of the user key: no shuffle under its joins."""
    names = store_star(given.star, f"{shared_folder(given.spark)}/buckets-{uuid.uuid4().hex}", BUCKETS)
    return publish(user_rollup(bucketed_star(given.spark, names), "corrected").drop("email"))


@query
def daily_series_bucketed(given):
    """The series over daily metrics and users in buckets of the user key."""
    path = f"{shared_folder(given.spark)}/buckets-{uuid.uuid4().hex}"
    stored = [
        write_bucketed(df, f"{name}_{uuid.uuid4().hex[:12]}", f"{path}/{name}", BUCKETS)
        for name, df in [("daily", given.window), ("users", given.star.users.where(F.col("account_status").isin(KEPT_STATUS)))]
    ]
    return publish(ser.daily_series(*stored, SETTINGS.as_of, SETTINGS.history_days))


@query
def user_features_base(given):
    return publish(given.base.drop("email").orderBy("user_key"))


@query
def user_features_realistic(given):
    return publish(given.realistic.drop("email").orderBy("user_key"))


# --- features, labels, noise ------------------------------------------------------

@query
def derived_features(given):
    return publish(given.derived.select(
        "user_key", "session_frequency", "quiz_completion_rate", "quiz_abandon_rate", "engagement_trend",
        "activity_diversity", "challenge_success_ratio", "consistency_index",
    ))


@query
def imputed_safe_features(given):
    return publish(given.kept.safe.select("user_key", "churned", *feats.SAFE_FEATURES))


@query
def noisy_features(given):
    out = noisy.add_noise(given.kept.base, SETTINGS.noise_level, SETTINGS.seed)
    return publish(out.select("user_key", *noisy.PERCENTAGES, *noisy.FLOORED))


@query
def flipped_labels(given):
    users = given.kept.base.select("user_key", "churned")
    return noisy.flip_labels(users, SETTINGS.flip_rate, SETTINGS.seed)


@query
def flipped_labels_approx(given):
    users = given.base.select("user_key", "churned")
    return noisy.flip_labels(users, SETTINGS.flip_rate, SETTINGS.seed, mode="approx")


@query
def chosen_labels(given):
    chosen, approach = labels.choose_labels(given.kept.base, given.kept.realistic, SETTINGS)
    return chosen.select("user_key", "churned", F.lit(approach).alias("approach"))


# --- profile ----------------------------------------------------------------------

@query
def churn_label_counts(given):
    return publish(labels.label_stats(given.base))


@query
def churn_rate(given):
    return publish(labels.label_rate(given.base))


@query
def risk_category_counts(given):
    return publish(labels.risk_distribution(given.realistic))


@query
def null_counts(given):
    return profile.null_counts(given.model_users.drop("email"))


@query
def numeric_profile(given):
    return publish(profile.numeric_profile(given.kept.derived))


@query
def label_correlations(given):
    return publish(profile.correlations(given.kept.safe, feats.SAFE_FEATURES))


@query
def label_correlations_top(given):
    return publish(profile.correlations(given.kept.safe, feats.SAFE_FEATURES).limit(10))


@query
def screened_features(given):
    users = given.kept.safe
    correlated = profile.correlations(users, feats.SAFE_FEATURES)
    kept = profile.screen(correlated, feats.SAFE_FEATURES, SETTINGS.correlation_limit)
    return publish(correlated.withColumn("kept", F.col("feature").isin(kept)))


@query
def screened_leak(given):
    """The same screen with a feature that gives the label away."""
    users = given.kept.safe.withColumn("leak", F.col("churned") * 10 + F.col("total_sessions") % 3)
    candidates = [*feats.SAFE_FEATURES, "leak"]
    kept = profile.screen(profile.correlations(users, candidates), candidates, SETTINGS.correlation_limit)
    return users.sparkSession.createDataFrame([(c,) for c in kept], "feature string")


# --- splits and scaling -----------------------------------------------------------

@query
def stratified_test_rows(given):
    users = given.kept.model_users.select("user_key", "churned")
    return split.mark_test(users, "churned", SETTINGS.test_share, SETTINGS.seed)


@query
def stratified_test_rows_approx(given):
    users = given.model_users.select("user_key", "churned")
    return split.mark_test(users, "churned", SETTINGS.test_share, SETTINGS.seed, mode="approx")


@query
def ordered_split(given):
    first, rest = split.ordered_split(given.kept.rollup.select("user_key"))
    return first.withColumn("part", F.lit("train")).unionByName(rest.withColumn("part", F.lit("validation")))


@query
def ordered_split_from_states(given):
    users = given.kept.rollup.select("user_key", "account_status")
    cut = split.state_cut(split.key_states(users, "account_status"))
    return split.cut_error(users, cut).select("n_rows", (F.col("rank_error") <= split.rank_bound()).alias("within_bound"))


@query
def forecaster_split(given):
    users = given.kept
    return analysis.split_sizes(*split.split_series(users.series, users.rollup.select("user_key")))


@query
def sampled_users(given):
    return split.sample_users(given.kept.rollup, 50, SETTINGS.seed).select("user_key")


@query
def stratified_folds(given):
    users = given.kept.model_users.select("user_key", "churned")
    return split.stratified_folds(users, "churned", SETTINGS.folds, SETTINGS.seed)


@query
def standardised_features(given):
    users = given.kept.safe
    scaler = scaling.fit_standard(users, feats.SAFE_FEATURES)
    return publish(scaler.transform(users).select("user_key", *feats.SAFE_FEATURES))


@query
def min_max_targets(given):
    targets = durable(given.targets)
    return publish(scaling.fit_min_max(targets, ser.METRICS).transform(targets))


@query
def min_max_round_trip(given):
    targets = durable(given.targets)
    scaler = scaling.fit_min_max(targets, ser.METRICS)
    return publish(scaler.inverse(scaler.transform(targets)))


# --- series and forecast ----------------------------------------------------------

@query
def daily_series(given):
    return publish(given.series)


@query
def series_features(given):
    return publish(ser.series_features(given.series, SETTINGS))


@query
def series_targets(given):
    return publish(ser.series_targets(given.series, SETTINGS))


@query
def widened_targets(given):
    return publish(risk.widen_forecast(ser.series_targets(given.series, SETTINGS)))


@query
def trend_forecast(given):
    return publish(given.kept.forecast)


@query
def trend_forecast_error(given):
    cells = forecast_cells(given.kept.trend, given.kept.series, SETTINGS)
    return publish(diagnosis.regression_error(cells))


@query
def forecast_totals(given):
    return risk.forecast_totals(given.kept.forecast)


# --- risk and actions -------------------------------------------------------------

@query
def user_risk(given):
    return publish(risk.ranked(given.kept.risk))


@query
def high_risk_users(given):
    return publish(risk.high_risk(given.kept.risk).select("user_key", "user_id", "avg_churn_risk"))


@query
def high_risk_users_top20(given):
    return publish(risk.high_risk(given.kept.risk, n=20).select("user_key", "user_id", "avg_churn_risk"))


@query
def high_risk_total(given):
    return reports.high_risk_report(given.kept.forecast, given.kept.risk)["total_high_risk"]


@query
def users_by_status(given):
    groups = risk.by_status(given.kept.risk)
    sides = [g.select("user_key", F.lit(name).alias("status_group")) for name, g in groups.items()]
    return sides[0].unionByName(sides[1])


@query
def status_counts(given):
    return risk.status_counts(given.kept.risk)


@query
def risk_bands(given):
    return publish(risk.risk_bands(given.kept.risk))


@query
def risk_summary(given):
    return publish(risk.risk_summary(given.kept.risk))


@query
def recommendations_live(given):
    return publish(codes(given.kept.recommended.select("user_key", "avg_churn_risk", "recommendations")))


@query
def recommendations_classic(given):
    return codes(act.actions(given.kept.risk, "classic").select("user_key", "recommendations"))


@query
def recommendations_tiers(given):
    return codes(act.actions(given.kept.risk, "tiers").select("user_key", "recommendations"))


@query
def tier_risk_days(given):
    """High-risk days as the tiers-only rules count them."""
    tiers = act.actions(risk.user_risk(given.kept.forecast, high_day=6), "tiers")
    return publish(codes(tiers.select("user_key", "days_high_risk", "max_churn_risk", "recommendations")))


@query
def heuristic_risk(given):
    return publish(risk.heuristic_risk(given.kept.rollup).select("user_key", "user_id", "risk_score"))


@query
def top_actions(given):
    return act.top_actions(given.kept.recommended)


@query
def recommendations_top20(given):
    return publish(codes(reports.top_recommendations(given.kept.recommended)))


@query
def recommendations_csv(given):
    return publish(sinks.csv_frame(given.kept.recommended))


# --- scores and curves ------------------------------------------------------------

@query
def roc_curve(given):
    return publish(curves.roc_points(given.totals))


@query
def roc_curve_corners(given):
    return publish(curves.roc_points(given.totals, corners_only=True))


@query
def precision_recall_curve(given):
    return publish(curves.pr_points(given.totals))


@query
def curve_areas(given):
    return publish(curves.curve_areas(given.totals))


@query
def curve_area_bounds(given):
    """The area from a mergeable histogram, its error bound, and whether the exact area is within."""
    parts = [given.scores.where(F.pmod("user_key", F.lit(3)) == k) for k in range(3)]
    states = [curves.score_histogram(part) for part in parts]
    merged = states[0].union(states[1]).union(states[2]).groupBy("bin").agg(F.sum("positives").alias("positives"), F.sum("negatives").alias("negatives"))
    exact = curves.curve_areas(given.totals).select("roc_auc").scalar()
    found = curves.histogram_area(merged).withColumn("exact", exact)
    return publish(found.select("area", "error", (F.abs(F.col("exact") - F.col("area")) <= F.col("error") + 1e-12).alias("within")))


@query
def distinct_active_users(given):
    """Active users per month, merged from the bitmaps of days, and over all time."""
    days = distinct.distinct_state(given.activity, [F.trunc("last_activity_date", "month").alias("month"), "last_activity_date"])
    months = durable(distinct.merge_distinct(days, ["month"]))
    whole = distinct.merge_distinct(months, [F.lit(None).cast("date").alias("month")])
    return distinct.count_distinct(months, ["month"]).union(distinct.count_distinct(whole, ["month"]))


@query
def score_stats(given):
    return publish(diagnosis.score_stats(given.scores))


@query
def score_overlap(given):
    return publish(diagnosis.overlap_ratio(given.scores))


@query
def extreme_scores(given):
    return publish(diagnosis.extreme_scores(given.scores))


@query
def class_weights(given):
    return publish(classifier.class_weights(given.model_users))


# --- charts and reports -----------------------------------------------------------

@query
def first_forecasts(given):
    return publish(reports.first_forecasts(given.kept.forecast).select(
        "user_key", "prediction_day", "predicted_churn_risk", "predicted_engagement_level",
    ))


@query
def chart_forecast_lines(given):
    return publish(reports.chart_lines(given.kept.forecast, users=given.kept.rollup))


@query
def detailed_users(given):
    top = reports.detailed_users(given.kept.recommended)
    return publish(codes(top.select(
        "rank", "user_id", F.col("status.text").alias("status_text"), F.col("status.code").alias("status_code"),
        "metrics.*", "recommendations",
    )))


@query
def detailed_report_json(given):
    """Fields read back from the one JSON document."""
    ready = given.reported
    report = reports.detailed_report(ready.forecast, ready.recommended, SETTINGS.as_of)
    paths = {
        "users_in_report": ("$.metadata.total_users_in_report", "bigint"), "generated_at": ("$.metadata.generated_at", "string"),
        "total_users": ("$.risk_summary.total_users", "bigint"), "low_users": ("$.risk_summary.risk_distribution[0].users", "bigint"),
        "high_users": ("$.risk_summary.risk_distribution[2].users", "bigint"),
        "total_predictions": ("$.model_statistics.total_predictions", "bigint"),
        "first_user": ("$.intervention_recommendations[0].user_id", "string"),
        "fifth_user": ("$.intervention_recommendations[4].user_id", "string"),
        "first_action": ("$.intervention_recommendations[0].recommendations[0]", "string"),
    }
    return sinks.json_rows(report).select(*[F.get_json_object("json", path).cast(kind).alias(name) for name, (path, kind) in paths.items()])


@query
def user_json_rows(given):
    users = given.base.select(
        "user_key", "user_id", "age", "last_activity_date", "total_sessions", "avg_engagement", "is_verified", "churned",
    )
    return sinks.json_rows(publish(users))


@query
def label_count_map(given):
    counts = sinks.stats_map(labels.label_stats(given.base), "churned", "users")
    return counts.select(F.to_json("stats").alias("stats"))


# --- models: what must hold for any fit --------------------------------------------

@query
def classifier_scores(given):
    scores = analysis.classify(given.prepared, SETTINGS, cross_validate=False).scores
    return scores.select(
        "user_key", "churned", F.col("score").between(0, 1).alias("in_range"),
        (F.col("predicted") == (F.col("score") >= 0.5).cast("int")).alias("consistent"),
    )


@query
def classifier_importances(given):
    found = analysis.classify(given.prepared, SETTINGS, cross_validate=False).importance
    return found.agg(
        F.count("*").alias("features"), F.countDistinct("feature").alias("names"),
        F.round(F.sum("importance"), 6).alias("total"), (F.min("importance") >= 0).alias("none_negative"),
    )


@query
def classifier_cross_validation(given):
    ready = given.prepared
    mean, std = classifier.cv_auc(ready.users, ready.selected, SETTINGS)
    return ready.users.agg(
        F.count("*").alias("users"), F.lit(0.0 <= mean <= 1.0).alias("mean_in_range"), F.lit(std >= 0.0).alias("spread_not_negative")
    )


@query
def score_diagnosis(given):
    return publish(diagnosis.diagnose(given.scores))


def _forest_rows(forecast: DataFrame) -> DataFrame:
    """Per user: forecast days, and whether all values are in range."""
    metrics = " AND ".join(f"predicted_{m} >= 0" for m in ser.METRICS)
    return forecast.groupBy("user_key").agg(
        F.count("*").alias("days"), F.min("prediction_day").alias("first_day"), F.max("prediction_day").alias("last_day"),
        F.bool_and(F.expr(f"predicted_churn_risk BETWEEN 0 AND 1 AND {metrics}")).alias("in_range"),
    )


@query
def forest_forecast(given):
    """One forest for each metric and day."""
    ready = given.kept
    history = durable(ready.series)
    train, _ = split.split_series(history, ready.rollup.select("user_key"))
    return _forest_rows(analysis.forecast_users(fit_forecaster(train, QUICK), history, ready.model_users, QUICK))


@query
def forest_forecast_per_metric(given):
    ready = given.kept
    history = durable(ready.series)
    train, _ = split.split_series(history, ready.rollup.select("user_key"))
    return _forest_rows(analysis.forecast_users(fit_forecaster(train, QUICK, "per_metric"), history, ready.model_users, QUICK))


@query
def loaded_model_forecast(given):
    """A forecast by the stored model of these tables."""
    return _forest_rows(given.scored.forecast)


@query
def stored_model_risk(given):
    """The risk table, the list of high-risk users and the actions that follow from the stored model,
    each recomputed from the forecast it published."""
    done = given.scored
    again = done.forecast.groupBy("user_key").agg(
        F.round(F.avg("predicted_churn_risk"), 6).alias("mean"), F.round(F.max("predicted_churn_risk"), 6).alias("most"),
    )
    high = risk.high_risk(done.risk).select("user_key", F.lit(True).alias("listed"))
    both = done.recommended.join(again, "user_key", "left").join(high, "user_key", "left")
    return both.select(
        "user_key", "user_id", (F.abs(F.col("avg_churn_risk") - F.col("mean")) < 1e-5).alias("mean_agrees"),
        (F.abs(F.col("max_churn_risk") - F.col("most")) < 1e-5).alias("max_agrees"),
        (F.coalesce("listed", F.lit(False)) == (F.col("avg_churn_risk") > 0.6)).alias("listed_if_high"),
        (F.size("recommendations") > 0).alias("has_actions"),
    )


@query
def stored_model_report(given):
    """The detailed report of the stored model, read back from its JSON document."""
    done = given.scored
    report = reports.detailed_report(done.forecast, done.recommended, SETTINGS.as_of)
    paths = {
        "users_in_report": "$.metadata.total_users_in_report", "total_users": "$.risk_summary.total_users",
        "low": "$.risk_summary.risk_distribution[0].users", "medium": "$.risk_summary.risk_distribution[1].users",
        "high": "$.risk_summary.risk_distribution[2].users", "total_predictions": "$.model_statistics.total_predictions",
    }
    read = sinks.json_rows(report).select(*[F.get_json_object("json", path).cast("bigint").alias(name) for name, path in paths.items()])
    return read.select("users_in_report", "total_users", "total_predictions", (F.col("low") + F.col("medium") + F.col("high") <= F.col("total_users")).alias("bands_fit"))


@query
def stored_model_charts(given):
    """Rows of every chart set of the stored model."""
    sizes = [frame.agg(F.lit(name).alias("chart"), F.count("*").alias("points")) for name, frame in given.scored.charts.items()
             if not name.endswith("_curve")]
    sized = sizes[0]
    for frame in sizes[1:]:
        sized = sized.union(frame)
    return sized


@query
def stored_model_importances(given):
    """The ranked importances that the chart shows: ten at most, falling, of screened features."""
    shown = given.scored.charts["feature_importance"]
    falling = F.lag("importance").over(W.orderBy(F.col("importance").desc(), "feature"))
    ranked = shown.withColumn("before", falling)  # ten rows
    return ranked.agg(
        F.count("*").alias("shown"), F.bool_and(F.coalesce(F.col("before") >= F.col("importance"), F.lit(True))).alias("falling"),
        F.bool_and(F.col("importance").between(0, 1)).alias("in_range"), F.bool_and(F.col("feature").isin(feats.SAFE_FEATURES)).alias("known"),
    )


@query
def full_analysis_summary(given):
    """Every frame of the analysis is computed; published is what holds for any fit."""
    ready = given.kept
    done = analysis.run(ready.star, QUICK, ready.daily)
    lazy = [*done.prepared.profile.values(), *done.charts.values(), done.diagnosis, done.classified.importance, done.split,
            done.top_recommended, done.report]
    for frame in lazy:
        frame.write.format("noop").mode("overwrite").save()
    bands = "risk_distribution.low_users + risk_distribution.medium_users + risk_distribution.high_users"
    return done.summary.selectExpr(
        "total_users_analyzed", "active_users + churned_users AS users_by_status", f"{bands} <= total_users_analyzed AS bands_fit",
        "prediction_days", "total_predictions", "churn_model_auc BETWEEN 0 AND 1 AS auc_in_range",
        "future_model_mae >= 0 AND future_model_mse >= 0 AS error_not_negative", "validation_cells",
    )
