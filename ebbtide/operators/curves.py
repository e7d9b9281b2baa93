"""ROC and precision-recall curves and their areas over a score table.

A curve needs running totals over all distinct scores. They are built in two levels:
totals per score bucket (at most ``MAX_BUCKETS`` rows) give each bucket its starting point,
and the buckets then run side by side. Buckets hold equal numbers of distinct scores, so one
score that most rows share weighs no more than any other. The curve is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.operators.order_stats import bucket_of, split_points
from ebbtide.session import durable

#: Distinct scores that one window task orders, and the most buckets; beyond it buckets grow.
SCORES_PER_BUCKET, MAX_BUCKETS = 20_000, 512


def threshold_totals(scores: DataFrame, label: str = "churned", score: str = "score") -> DataFrame:
    """One row per distinct score, highest first in meaning: rows at the score (pos, neg),
    rows at or above it (tp, fp), class totals, and the counts of the next lower score.
    Building it runs jobs: the counts by score are written once, and read for the buckets."""
    by_score = scores.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    by_score = durable(by_score)
    distinct = by_score.count()
    buckets = min(MAX_BUCKETS, max(1, distinct // SCORES_PER_BUCKET))
    points = split_points(by_score, "threshold", buckets)
    by_score = by_score.withColumn("bucket", bucket_of(F.col("threshold"), points))
    counts = F.struct("pos", "neg")
    per_bucket = by_score.groupBy("bucket").agg(
        F.sum("pos").alias("bucket_pos"),
        F.sum("neg").alias("bucket_neg"),
        F.max_by(counts, "threshold").alias("head"),
    )
    downward = W.orderBy(F.col("bucket").desc())
    before = downward.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    starts = per_bucket.select(
        "bucket",
        F.coalesce(F.sum("bucket_pos").over(before), F.lit(0)).alias("tp_before"),
        F.coalesce(F.sum("bucket_neg").over(before), F.lit(0)).alias("fp_before"),
        F.sum("bucket_pos").over(everything).alias("total_pos"),
        F.sum("bucket_neg").over(everything).alias("total_neg"),
        F.lead("head").over(downward).alias("next_head"),
    )
    inner = W.partitionBy("bucket").orderBy(F.col("threshold").desc())
    running = inner.rowsBetween(W.unboundedPreceding, 0)
    return by_score.join(F.broadcast(starts), "bucket").select(
        "threshold", "pos", "neg",
        (F.col("tp_before") + F.sum("pos").over(running)).alias("tp"),
        (F.col("fp_before") + F.sum("neg").over(running)).alias("fp"),
        "total_pos", "total_neg",
        F.coalesce(F.lead(counts).over(inner), F.col("next_head")).alias("following"),
    )


def roc_points(totals: DataFrame, corners_only: bool = False) -> DataFrame:
    """(threshold, fpr, tpr), starting at the origin with a null threshold.

    ``corners_only`` leaves out points on the straight line between their neighbours.
    """
    curve = totals
    if corners_only:
        same = (F.col("following.pos") == F.col("pos")) & (F.col("following.neg") == F.col("neg"))
        first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        curve = totals.where(first | F.col("following").isNull() | ~same)
    points = curve.select(
        "threshold",
        (F.col("fp") / F.nullif("total_neg", F.lit(0))).alias("fpr"),
        (F.col("tp") / F.nullif("total_pos", F.lit(0))).alias("tpr"),
    )
    origin = totals.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return points.unionByName(origin)


def pr_points(totals: DataFrame) -> DataFrame:
    """(threshold, precision, recall), closed by the point recall 0, precision 1."""
    points = totals.select(
        "threshold",
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.nullif("total_pos", F.lit(0))).alias("recall"),
    )
    closing = totals.sparkSession.createDataFrame(
        [(None, 1.0, 0.0)], "threshold double, precision double, recall double"
    )
    return points.unionByName(closing)


def curve_areas(totals: DataFrame) -> DataFrame:
    """ROC-AUC and PR-AUC by trapezoids, null when a class is empty.

    Each row knows the point before it (its totals minus its own counts), so no
    neighbouring row has to be looked up.
    """
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    before = tp - pos + fp - neg
    precision_before = F.when(before == 0, 1.0).otherwise((tp - pos) / F.nullif(before, F.lit(0)))
    positives, negatives = F.max("total_pos"), F.max("total_neg")
    return totals.agg(
        (F.sum(neg * (tp + tp - pos)) / F.nullif(2 * positives * negatives, F.lit(0))).alias("roc_auc"),
        (
            F.sum(pos * (tp / (tp + fp) + precision_before)) / F.nullif(2 * positives, F.lit(0))
        ).alias("pr_auc"),
    )


def score_histogram(scores: DataFrame, bins: int = 1000, label: str = "churned") -> DataFrame:
    """(bin, positives, negatives) of scores from 0 to 1: a state of at most ``bins`` rows.

    Histograms of parts of the rows add up to that of all: sum both counts by bin."""
    place = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin")
    positive = F.col(label) == 1
    return scores.groupBy(place).agg(F.count_if(positive).alias("positives"), F.count_if(~positive).alias("negatives"))


def histogram_area(histogram: DataFrame) -> DataFrame:
    """The area under the ROC curve from a histogram, with a bound on its error.

    Pairs of a positive and a negative in different bins count exactly. Those within a bin count
    half, so the exact area lies within half their share of all pairs: ``error``. One row; null
    if a class is empty.
    """
    # At most as many rows as bins, so one task is enough.
    below = F.coalesce(F.sum("negatives").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pairs = F.col("positives") * F.col("negatives")
    parts = histogram.withColumn("below", below).agg(
        F.sum(F.col("positives") * F.col("below")).alias("apart"), F.sum(pairs).alias("together"),
        (F.sum("positives") * F.sum("negatives")).alias("all"),
    )
    return parts.select(
        F.try_divide(F.col("apart") + F.col("together") / 2.0, "all").alias("area"), F.try_divide(F.col("together") / 2.0, "all").alias("error")
    )

