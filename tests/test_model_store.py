"""Fit ledger, forest table and model store: resumed fits, whole versions, scoring without a fit."""

import os
import subprocess
import sys
from dataclasses import replace

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from ebbtide.operators.classifier import score
from ebbtide.operators.forecaster import FitLedger, fit_forecaster
from ebbtide.operators.forest_table import forest_table, predict_trees
from ebbtide.operators.series import METRICS, series_features
from ebbtide.plans.analysis import run, score_state
from ebbtide.plans.queries import SETTINGS, Inputs
from ebbtide.settings import ForestSize
from ebbtide.sources.driver_tables import tables_mark
from ebbtide.sources.files import Folder
from ebbtide.sources.model_store import ModelStore

FOLDER = "/root/testdata/sf0.001"
SMALL = replace(SETTINGS, classifier=ForestSize(8, 3, 2, "0.5"), forecaster=ForestSize(3, 2, 1, "all"), folds=2)


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    given = Inputs(spark, FOLDER)
    return run(given.star, SMALL, given.daily, mode="per_metric", cross_validate=False, ledger=str(tmp_path_factory.mktemp("fits")))


def no_fit(*_):
    raise AssertionError("a fit")


def points(spark, n=300):
    columns = [F.rand(s).alias(f"x{s}") for s in range(4)]
    return spark.range(n).select(F.col("id").alias("user_key"), *columns).withColumn("y", F.col("x0") * 3 + F.sin(F.col("x1") * 9) + F.col("x2") * F.col("x3"))


def test_table_predicts_what_the_forests_predict(spark, tmp_path):
    data, inputs = points(spark).cache(), ["x0", "x1", "x2", "x3"]
    out = data
    for name, trees, depth in [("one", 1, 0), ("few", 7, 3), ("deep", 30, 10)]:
        forest = RandomForestRegressor(featuresCol="f", labelCol="y", predictionCol=f"ml_{name}", numTrees=trees, maxDepth=depth, seed=3)
        model = Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="f"), forest]).fit(data)
        model.stages[-1].save(f"{tmp_path}/{name}")
        out = model.transform(out).drop("f")
    trees = forest_table(spark, str(tmp_path), ["one", "few", "deep"]).cache()
    assert trees.count() == 38 and trees.where("target = 'one'").first().feature == [-1]
    for limit in (1 << 30, 1):  # in one pass, and in one for each forest
        got = predict_trees(data, trees, inputs, ["few", "deep", "one"], ["user_key"], limit)
        assert got.columns == ["user_key", "few", "deep", "one"]
        both = got.join(out, "user_key")
        assert both.count() == 300 and both.where("one <> ml_one OR few <> ml_few OR deep <> ml_deep").count() == 0
    assert predict_trees(data.limit(0), trees, inputs, ["few"], ["user_key"]).count() == 0
    with pytest.raises(ValueError, match="gone"):
        predict_trees(data, trees, inputs, ["gone"], ["user_key"])


SCRIPT = """
import os, sys
sys.path.insert(0, {repo!r})
from ebbtide.operators import forecaster
from ebbtide.plans.queries import Inputs
from ebbtide.session import local_session
from test_model_store import FOLDER, SMALL, history
spark, made, plain = local_session(4, 4), [], forecaster._regressor
def dying(*args):
    made.append(args)
    if len(made) == 5:
        os._exit(9)
    return plain(*args)
forecaster._regressor = dying
forecaster.fit_forecaster(history(Inputs(spark, FOLDER)), SMALL, "per_metric", 1, {ledger!r})
"""


def history(given):
    return given.series


def test_a_killed_driver_loses_the_fit_under_way_alone(spark, tmp_path, monkeypatch):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    ledger = str(tmp_path / "fits")
    code = SCRIPT.format(repo=repo, ledger=ledger)
    path = f"{repo}:{os.path.join(repo, 'tests')}"
    died = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": path}, capture_output=True, timeout=240)
    assert died.returncode == 9, died.stderr.decode()[-2000:]
    (name,) = os.listdir(ledger)
    finished = [n for n in os.listdir(f"{ledger}/{name}") if not n.startswith("draft-")]
    assert len(finished) == 4
    before = {n: os.stat(f"{ledger}/{name}/{n}/metadata").st_mtime_ns for n in finished}
    fitted, plain = [], RandomForestRegressor.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, df: fitted.append(self.getLabelCol()) or plain(self, df))
    series = history(Inputs(spark, FOLDER))
    model = fit_forecaster(series, SMALL, "per_metric", ledger=ledger)
    assert sorted([*fitted, *finished]) == sorted(METRICS)
    assert before == {n: os.stat(f"{ledger}/{name}/{n}/metadata").st_mtime_ns for n in finished}
    assert model.predict(series_features(series, SMALL)).where("session_duration IS NULL").count() == 0
    monkeypatch.setattr(RandomForestRegressor, "fit", no_fit)
    assert fit_forecaster(series, SMALL, "per_metric", ledger=ledger).trees.count() == 3 * len(METRICS)


def test_ledger_tells_rows_and_settings_apart(spark, tmp_path):
    data = points(spark)
    base = FitLedger(data, {"depth": 3}, str(tmp_path)).folder.path
    assert base == FitLedger(data.orderBy(F.desc("x1")), {"depth": 3}, str(tmp_path)).folder.path
    others = [FitLedger(data, {"depth": 4}, str(tmp_path)), FitLedger(data.where("user_key > 0"), {"depth": 3}, str(tmp_path)),
              FitLedger(data.withColumn("y", F.col("y") + 1), {"depth": 3}, str(tmp_path))]
    assert len({base, *[o.folder.path for o in others]}) == 4


def test_stored_state_scores_without_a_fit(spark, results, tmp_path, monkeypatch):
    store = ModelStore(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        store.load()
    assert store.save(results.state) == 1
    monkeypatch.setattr("pyspark.ml.base.Estimator.fit", no_fit)
    loaded = store.load()
    done = score_state(loaded, SMALL)
    assert done.forecast.exceptAll(results.forecast).count() == 0 and done.forecast.count() == results.forecast.count()
    assert done.risk.exceptAll(results.risk).count() == 0
    assert {n: f.count() for n, f in done.charts.items()} == {n: f.count() for n, f in results.charts.items()}
    assert done.charts["feature_importance"].collect() == results.charts["feature_importance"].collect()
    assert loaded.forecaster.horizon_days == 15 and loaded.forecaster.mode == "per_metric"
    assert (loaded.selected, loaded.approach, loaded.as_of) == (results.prepared.selected, "realistic", SETTINGS.as_of)
    again = score(loaded.classifier, loaded.scaler.transform(loaded.users), ["user_key"])
    first = score(results.classified.model, results.classified.scaler.transform(results.prepared.users), ["user_key"])
    assert first.exceptAll(again).count() == 0


def test_versions_are_whole_or_not_there(spark, results, tmp_path, monkeypatch):
    store = ModelStore(spark, str(tmp_path))
    assert [store.save(results.state), store.save(results.state)] == [1, 2]
    monkeypatch.setattr(Folder, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError):
        store.save(results.state)
    monkeypatch.undo()
    states = [n for n in os.listdir(tmp_path) if n.startswith("state-")]
    assert len(states) == 3 and store.versions() == [1, 2]
    # Another writer took the number first: the next one is used, nothing is replaced.
    held, seen = Folder.publish, []

    def late(self, name, text):
        if not seen:
            seen.append(held(self, name, text.replace("per_metric", "other")))
        return held(self, name, text)

    monkeypatch.setattr(Folder, "publish", late)
    assert store.save(results.state) == 4 and seen == [True] and store.load(3).forecaster.mode == "other"
    assert store.expire(keep=1) == [1, 2, 3] and store.versions() == [4] and store.load().forecaster.mode == "per_metric"
    with pytest.raises(FileNotFoundError):
        store.load(1)


def test_mark_changes_with_the_files(spark, tmp_path):
    for table in ("customer", "events", "orders"):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    before = tables_mark(spark, str(tmp_path))
    assert before == tables_mark(spark, str(tmp_path)) != tables_mark(spark, FOLDER)
    spark.read.parquet(f"{FOLDER}/orders.parquet").limit(3).write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    assert before != tables_mark(spark, str(tmp_path))
