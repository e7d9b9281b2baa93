"""Exact ranks and curves against brute force, on skewed and tied data."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ebbtide.functions.draws import uniform
from ebbtide.operators import curves
from ebbtide.operators.curves import curve_areas, pr_points, roc_points, threshold_totals
from ebbtide.operators.diagnosis import extreme_scores, overlap_ratio, score_stats
from ebbtide.operators.noise import flip_labels
from ebbtide.operators.order_stats import exact_quantiles, few_groups, value_at_share
from ebbtide.operators.profile import correlations, screen
from ebbtide.operators.scaling import fit_min_max, fit_standard
from ebbtide.operators.split import mark_test, ordered_split, split_series, stratified_folds


def skewed(n, seed=7):
    """A third of all values are one number; the rest spans eight orders of magnitude."""
    rng = np.random.default_rng(seed)
    values = np.exp(rng.normal(0, 4, n))
    values[: n // 3] = 5.0
    return rng.permutation(values)


def test_quantiles_of_skewed_data(spark):
    values = skewed(20_000)
    df = spark.createDataFrame([(float(v), None if i % 5 == 0 else float(i)) for i, v in enumerate(values)], "a double, b double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = exact_quantiles(df, ["a", "b"], probs)
    rest = [i for i in range(20_000) if i % 5]
    assert found["a"] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)
    assert found["b"] == pytest.approx(list(np.quantile(rest, probs)), rel=1e-12)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6), st.sampled_from([0.0, 1.0, float("nan")])), max_size=40))
def test_quantiles_of_anything(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "a double")
    clean = [v for v in values if v is not None and not np.isnan(v)]
    found = exact_quantiles(df, ["a"], [0.25, 0.5])["a"]
    if not clean:
        assert found == [None, None]
    else:
        assert found == pytest.approx(list(np.quantile(clean, [0.25, 0.5])), abs=1e-6)


def test_value_at_share_keeps_big_keys(spark):
    base = 2**60
    df = spark.createDataFrame([(base + i,) for i in range(101)], "k long")
    assert value_at_share(df, "k", 0.8) == base + 79
    assert value_at_share(df.limit(1), "k", 0.8) is not None


def test_splits_are_exact(spark):
    df = spark.range(5003).select(F.col("id").alias("user_key"), (F.col("id") % 3 == 0).cast("int").alias("churned"))
    counts = {(r.churned, r.is_test): r["count"] for r in mark_test(df, "churned", 0.2, 1).groupBy("churned", "is_test").count().collect()}
    assert counts == {(0, True): 667, (0, False): 2668, (1, True): 334, (1, False): 1334}
    folds = stratified_folds(df, "churned", 5, 1).groupBy("churned", "fold").count().collect()
    assert sorted(r["count"] for r in folds) == [333, 333, 334, 334, 334] + [667] * 5
    first, rest = ordered_split(df)
    assert (first.count(), rest.agg(F.min("user_key")).first()[0]) == (4002, 4002)
    flipped = flip_labels(df, 0.05, 1).join(df.withColumnRenamed("churned", "old"), "user_key")
    assert flipped.where("churned <> old").count() == 250
    assert flip_labels(df.limit(10), 0.05, 1).count() == 10


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id").alias("user_key"), (F.col("id") % 2).cast("int").alias("churned"))
    one = mark_test(df.coalesce(1), "churned", 0.2, 1).where("is_test")
    many = mark_test(df.repartition(7), "churned", 0.2, 1).where("is_test")
    assert sorted(r.user_key for r in one.collect()) == sorted(r.user_key for r in many.collect())


def brute_curve(labels, scores):
    points, order = [(0.0, 0.0)], np.argsort(-scores, kind="stable")
    labels, scores = labels[order], scores[order]
    tp, fp = np.cumsum(labels), np.cumsum(1 - labels)
    last = np.r_[np.nonzero(np.diff(scores))[0], len(scores) - 1]
    return tp[last], fp[last], scores[last]


@pytest.mark.parametrize("digits", [1, 12])
def test_curves(spark, digits):
    rng = np.random.default_rng(3)
    labels = (rng.random(3000) < 0.3).astype(int)
    scores = np.round(np.clip(rng.normal(0.4 + 0.2 * labels, 0.2), 0, 1), digits)
    scores[:1000] = 0.5
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(labels, scores)], "churned int, score double")
    tp, fp, cut = brute_curve(labels, scores)
    p, n = labels.sum(), len(labels) - labels.sum()
    totals = threshold_totals(df)
    roc = sorted((r.fpr, r.tpr) for r in roc_points(totals).collect())
    expected = sorted([(0.0, 0.0), *zip(fp / n, tp / p)])
    assert np.allclose(roc, expected)
    second = (np.diff(fp, 2) != 0) | (np.diff(tp, 2) != 0)
    keep = np.r_[True, second, True]
    corners = sorted((r.fpr, r.tpr) for r in roc_points(totals, corners_only=True).collect())
    assert np.allclose(corners, sorted([(0.0, 0.0), *zip((fp / n)[keep], (tp / p)[keep])]))
    precision, recall = np.r_[1.0, tp / (tp + fp)], np.r_[0.0, tp / p]
    assert pr_points(totals).count() == len(precision)
    areas = curve_areas(totals).first()
    assert areas.roc_auc == pytest.approx(np.trapezoid(np.r_[0, tp / p], np.r_[0, fp / n]))
    assert areas.pr_auc == pytest.approx(np.trapezoid(precision, recall))


def test_single_class_scores(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.99)], "churned int, score double")
    assert curve_areas(threshold_totals(df)).first().roc_auc is None
    assert overlap_ratio(df).first().overlap_ratio == 0.0
    assert extreme_scores(df).first().high == 1
    assert score_stats(df).first().median == pytest.approx(0.595)
    empty = df.where("score > 2")
    assert extreme_scores(empty).first().high_percentage == 0.0
    assert score_stats(empty).first().median is None


def test_constant_feature_is_kept(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0), (1.0, 1.0, 1), (1.0, None, 1)], "c double, leak double, churned int")
    found = correlations(df, ["c", "leak"])
    assert [(r.feature, r.correlation) for r in found.collect()] == [("leak", pytest.approx(1.0)), ("c", None)]
    assert screen(found, ["c", "leak"]) == ["c"]


def test_scalers_invert(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0)], "a double, b double")
    for fit in (fit_standard, fit_min_max):
        scaler = fit(df, ["a", "b"])
        assert {r.b for r in scaler.transform(df).collect()} == {0.0}
        assert sorted(map(tuple, scaler.inverse(scaler.transform(df)).collect())) == [(1.0, 4.0), (3.0, 4.0)]


def test_draws_are_uniform_and_independent(spark):
    df = spark.range(20_000).select(uniform([F.col("id")], "a").alias("u"), uniform([F.col("id")], "a", 1).alias("v"))
    row = df.agg(F.avg("u"), F.stddev("u"), F.corr("u", "v")).first()
    assert row[0] == pytest.approx(0.5, abs=0.01) and row[1] == pytest.approx(12 ** -0.5, abs=0.01)
    assert abs(row[2]) < 0.03


def test_one_score_that_most_rows_share(spark, monkeypatch):
    monkeypatch.setattr(curves, "SCORES_PER_BUCKET", 50)
    df = spark.range(20_000).selectExpr("int(id % 7 = 0) AS churned", "if(id % 100 < 99, 0.5D, id / 20000D) AS score")
    totals = threshold_totals(df)
    scores = np.array([(r.churned, r.score) for r in df.collect()])
    values = np.unique(scores[:, 1])[::-1]
    got = {r.threshold: (r.tp, r.fp) for r in totals.collect()}
    at = scores[:, 1]
    assert got == {v: (((at >= v) & (scores[:, 0] == 1)).sum(), ((at >= v) & (scores[:, 0] == 0)).sum()) for v in values}


def test_too_many_groups_are_refused(spark):
    with pytest.raises(ValueError):
        few_groups(spark.range(30), "id", limit=20)


@pytest.mark.parametrize("users,train", [(1, 1), (7, 5), (11, 8)])
def test_series_are_split_by_user(spark, users, train):
    keys = spark.range(users).withColumnRenamed("id", "user_key")
    series = keys.selectExpr("user_key", "explode(sequence(-30, -1)) AS day_offset")
    first, rest = split_series(series, keys)
    assert first.select("user_key").distinct().count() == train and rest.count() == 30 * (users - train)
