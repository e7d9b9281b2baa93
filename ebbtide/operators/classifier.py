"""Class-balanced random-forest churn classifier."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.operators.order_stats import few_groups
from ebbtide.operators.split import stratified_folds
from ebbtide.settings import ForestSize, Settings


def class_weights(df: DataFrame, label: str = "churned") -> DataFrame:
    """n / (2 * n_c) per class: both classes weigh the same in total."""
    counts = df.groupBy(label).agg(F.count("*").alias("users"))
    total = F.sum("users").over(W.partitionBy())
    return counts.select(label, "users", (total / (2.0 * F.col("users"))).alias("weight"))


def weighted(df: DataFrame, label: str = "churned") -> DataFrame:
    """Attach the class weight; the weight table has one row per class."""
    few_groups(df, label)
    return df.join(F.broadcast(class_weights(df, label).drop("users")), label)


def forest(size: ForestSize, seed: int, label: str = "churned", weight: str | None = "weight"):
    settings = dict(
        featuresCol="features", labelCol=label, numTrees=size.trees, maxDepth=size.depth,
        minInstancesPerNode=size.min_leaf, featureSubsetStrategy=size.features,
        maxBins=size.max_bins, seed=seed, maxMemoryInMB=size.node_memory_mb,
    )
    if weight:
        settings["weightCol"] = weight
    return RandomForestClassifier(**settings)


def fit_classifier(
    train: DataFrame, columns: list[str], size: ForestSize, seed: int, label: str = "churned", balanced: bool = True
) -> PipelineModel:
    assembler = VectorAssembler(inputCols=columns, outputCol="features")
    data = weighted(train, label) if balanced else train
    return Pipeline(stages=[assembler, forest(size, seed, label, "weight" if balanced else None)]).fit(data)


def score(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, the churn probability, and the label at the 0.5 threshold."""
    scored = model.transform(df).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*keep, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def cv_auc(train: DataFrame, columns: list[str], settings: Settings, label: str = "churned") -> tuple[float, float]:
    """Mean and population deviation of the ROC-AUC over stratified folds."""
    data = stratified_folds(weighted(train, label), label, settings.folds, settings.seed)
    data = VectorAssembler(inputCols=columns, outputCol="features").transform(data)
    evaluator = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC", numBins=0)
    model = CrossValidator(
        estimator=forest(settings.classifier, settings.seed, label),
        estimatorParamMaps=ParamGridBuilder().build(),
        evaluator=evaluator,
        numFolds=settings.folds,
        foldCol="fold",
        parallelism=2,
    ).fit(data.select(label, "weight", "fold", "features"))
    return model.avgMetrics[0], model.stdMetrics[0]


def importances(model: PipelineModel, columns: list[str], df: DataFrame) -> DataFrame:
    """(feature, importance), largest first; one row per feature."""
    values = model.stages[-1].featureImportances.toArray()
    pairs = [(c, float(v)) for c, v in zip(columns, values)]
    frame = df.sparkSession.createDataFrame(pairs, "feature string, importance double")
    return frame.orderBy(F.col("importance").desc(), "feature")
