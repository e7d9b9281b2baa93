"""Random-forest forecast of every metric over the horizon."""

from __future__ import annotations

import hashlib
import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.columns import rows
from ebbtide.operators.forest_table import forest_table, predict_trees
from ebbtide.operators.series import FEATURES, METRICS, second_half, series_features
from ebbtide.session import durable, shared_folder, spread
from ebbtide.settings import Settings
from ebbtide.sources.files import Folder

#: Training rows of a partition.
FIT_ROWS = 100_000


@dataclass(frozen=True)
class Forecaster:
    """Fitted forests as a table of trees. ``per_target``: one for each metric and day.
    ``per_metric``: nine, with the horizon day as a feature."""

    mode: str
    trees: DataFrame
    horizon_days: int

    def predict(self, features: DataFrame) -> DataFrame:
        """(user_key, horizon_day, nine metrics) for every user in ``features``."""
        days = F.sequence(F.lit(1), F.lit(self.horizon_days))
        if self.mode == "per_metric":
            at_days = spread(features).withColumn("horizon_day", F.explode(days))
            return predict_trees(at_days, self.trees, [*FEATURES, "horizon_day"], METRICS, ["user_key", "horizon_day"])
        names = [f"{m}_{d}" for m in METRICS for d in range(1, self.horizon_days + 1)]
        wide = predict_trees(spread(features), self.trees, FEATURES, names, ["user_key"])
        return wide.select("user_key", rows(
            F.struct(F.lit(d).alias("horizon_day"), *[F.col(f"{m}_{d}").alias(m) for m in METRICS])
            for d in range(1, self.horizon_days + 1)
        ))


class FitLedger:
    """Finished fits in a folder of their own for each set of training rows and settings.

    A model is saved under a draft name and renamed when it is whole, so a run that ends in
    between loses the fits under way and no others: the next run with the same rows and
    settings takes up the rest.
    """

    def __init__(self, data: DataFrame, about: dict, root: str | None = None) -> None:
        spark = data.sparkSession
        # Whole billionths, because the last bits of a sum may differ between runs; round() goes through decimals.
        rounded = [F.rint(F.col(c) * 1e9) for c in sorted(data.columns)]
        count, mark = data.agg(F.count("*"), F.bit_xor(F.xxhash64(*rounded))).first()
        names = json.dumps([about, sorted(data.columns), count, mark], sort_keys=True, default=str)
        self.rows = count
        self.folder = Folder(spark, f"{root or shared_folder(spark)}/fits-{hashlib.sha256(names.encode()).hexdigest()[:24]}")

    def finished(self) -> list[str]:
        return [n for n in self.folder.names() if not n.startswith("draft-")]

    def fit(self, names: list[str], make, parallelism: int) -> None:
        """Fit and save what is not there yet. Threads overlap the driver's part of independent
        fits; each has a pool of its own, between which a fair scheduler shares the cluster."""
        left = sorted(set(names) - set(self.finished()))
        context = self.folder.spark.sparkContext

        def one(name: str) -> None:
            context.setLocalProperty("spark.scheduler.pool", f"fit-{name}")
            draft = f"draft-{uuid.uuid4().hex}"
            make(name).save(f"{self.folder.path}/{draft}")
            # Another run may have been faster; its model is the same.
            if not self.folder.rename(draft, name):
                self.folder.delete(draft)
            context.setLocalProperty("spark.scheduler.pool", None)

        with ThreadPoolExecutor(parallelism) as pool:
            list(pool.map(one, left))


def training_rows(series: DataFrame, settings: Settings) -> DataFrame:
    """Features of the first half next to each day of the second; same partitioning."""
    return series_features(series, settings).join(second_half(series, settings), "user_key")


def _regressor(target: str, settings: Settings, rows_per_user: int) -> RandomForestRegressor:
    size = settings.forecaster
    return RandomForestRegressor(
        featuresCol="inputs", labelCol=target, numTrees=size.trees,
        maxDepth=size.depth, minInstancesPerNode=size.min_leaf * rows_per_user, featureSubsetStrategy=size.features,
        maxBins=size.max_bins, seed=settings.seed, maxMemoryInMB=size.node_memory_mb,
    )


def fit_forecaster(
    series: DataFrame, settings: Settings, mode: str = "per_target", parallelism: int = 8, ledger: str | None = None
) -> Forecaster:
    """Fit one forest per metric and horizon day, or with ``per_metric`` one per metric.

    ``per_target`` keeps one row per user, with every target as a column. ``per_metric`` fits
    fewer forests on one row per user and day; there the leaf size, which counts users, is
    multiplied by the days. The training rows are written out once and every forest reads
    them from there; finished forests are kept in a ledger under ``ledger``, by default in the
    shared folder, and not fitted again.
    """
    if mode == "per_metric":
        inputs, data = [*FEATURES, "horizon_day"], training_rows(series, settings)
        targets, rows_per_user = METRICS, settings.horizon_days
    elif mode == "per_target":
        inputs = FEATURES
        days = range(1, settings.horizon_days + 1)
        by_day = second_half(series, settings).groupBy("user_key").agg(*[
            F.max(F.when(F.col("horizon_day") == d, F.col(m))).alias(f"{m}_{d}") for m in METRICS for d in days
        ])
        data = series_features(series, settings).join(by_day, "user_key")
        targets, rows_per_user = [f"{m}_{d}" for m in METRICS for d in days], 1
    else:
        raise ValueError("mode must be 'per_metric' or 'per_target'")
    data = durable(data.select(*inputs, *targets))
    fits = FitLedger(data, {"mode": mode, "seed": settings.seed, "size": asdict(settings.forecaster)}, ledger)
    # Split statistics exist once per partition, at many bytes a row: few rows need few partitions.
    assembled = VectorAssembler(inputCols=inputs, outputCol="inputs").transform(data.repartition(1 + fits.rows // FIT_ROWS))
    ready = durable(assembled.select("inputs", *targets))
    fits.fit(targets, lambda t: _regressor(t, settings, rows_per_user).fit(ready.select("inputs", t)), parallelism)
    return Forecaster(mode, durable(forest_table(data.sparkSession, fits.folder.path, targets)), settings.horizon_days)


def forecast_cells(predicted: DataFrame, series: DataFrame, settings: Settings) -> DataFrame:
    """(user_key, horizon_day, metric, y, p): actual and predicted value of each target."""
    guess = predicted.select("user_key", "horizon_day", *[F.col(m).alias(f"p_{m}") for m in METRICS])
    both = second_half(series, settings).join(guess, ["user_key", "horizon_day"])
    return both.select("user_key", "horizon_day", rows(
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("y"), F.col(f"p_{m}").alias("p")) for m in METRICS
    ))
