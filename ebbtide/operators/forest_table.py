"""Fitted forests as a table with one row per tree, and predictions from it.

A saved forest has one row per node, numbered so that the left child follows its parent. The
table keeps of a node its feature (-1 for a leaf), its right child, and its threshold or, for
a leaf, its value. Such a table of any number of forests is read in one job, while loading the
forests themselves takes several jobs for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TREES = "target string, tree int, feature array<int>, right array<int>, value array<double>"
#: Bytes of trees that a scoring pass sends to the tasks; forests beyond it take further passes.
PASS_BYTES = 64 << 20
NODE_BYTES = 16


def forest_table(spark: SparkSession, folder: str, targets: list[str]) -> DataFrame:
    """The forests saved under ``folder/<target>``, all their weights being one."""
    nodes = spark.read.parquet(*[f"{folder}/{t}/data" for t in targets])
    leaf = F.col("nodeData.leftChild") < 0
    return (
        nodes.select(
            F.regexp_extract("_metadata.file_path", r"/([^/]+)/data/[^/]+$", 1).alias("target"), F.col("treeID").alias("tree"),
            F.struct(
                F.col("nodeData.id").alias("id"),
                F.when(leaf, -1).otherwise(F.col("nodeData.split.featureIndex")).alias("feature"),
                F.col("nodeData.rightChild").alias("right"),
                F.when(leaf, F.col("nodeData.prediction")).otherwise(F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0))).alias("value"),
            ).alias("node"),
        )
        # A tree has at most 2^(depth + 1) nodes.
        .groupBy("target", "tree").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
        .selectExpr("target", "tree", "nodes.feature AS feature", "nodes.right AS right", "nodes.value AS value")
    )


def _passes(trees: DataFrame, targets: list[str], limit: int) -> list[list[str]]:
    """The targets in groups whose trees have at most ``limit`` bytes; a larger forest alone."""
    sizes = {r.target: r.bytes for r in trees.groupBy("target").agg(F.sum(F.size("feature") * NODE_BYTES).alias("bytes")).collect()}
    missing = [t for t in targets if t not in sizes]
    if missing:
        raise ValueError(f"no forest for {', '.join(missing)}")
    groups, room = [], 0
    for target in targets:
        if sizes[target] > room:
            groups.append([])
            room = limit
        groups[-1].append(target)
        room -= sizes[target]
    return groups


def predict_trees(rows: DataFrame, trees: DataFrame, inputs: list[str], targets: list[str], key: list[str], limit: int = PASS_BYTES) -> DataFrame:
    """``key`` and for each target the mean over its trees; ``inputs`` are the features in order.

    Trees are few and of bounded size, rows are not: each pass reads the rows once.
    """
    scored = None
    for group in _passes(trees, targets, limit):
        part = _predict_some(rows, trees, inputs, group, key)
        scored = part if scored is None else scored.join(part, key)
    return scored.select(*key, *targets)


def _predict_some(rows: DataFrame, trees: DataFrame, inputs: list[str], targets: list[str], key: list[str]) -> DataFrame:
    forests = {}
    for r in trees.where(F.col("target").isin(targets)).orderBy("target", "tree").toArrow().to_batches():
        for k in range(r.num_rows):
            parts = [r.column(c)[k].values.to_numpy() for c in ("feature", "right", "value")]
            forests.setdefault(r.column("target")[k].as_py(), []).append(parts)
    packed = []
    for target in targets:
        starts = np.concatenate([[0], np.cumsum([len(f) for f, _, _ in forests[target]])])
        feature, _, value = (np.concatenate(c) for c in zip(*forests[target]))
        right = np.concatenate([right + at for (_, right, _), at in zip(forests[target], starts)])
        packed.append((starts[:-1].astype(np.int32), feature, right.astype(np.int32), value))
    shared = rows.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in inputs])
            out = [np.concatenate([_mean(x[at : at + 1024], *forest) for at in range(0, len(x), 1024)] or [np.zeros(0)]) for forest in shared.value]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in key], *map(pa.array, out)], [*key, *targets])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in key], *[f"`{t}` double" for t in targets]])
    return rows.select(*key, *[c for c in inputs if c not in key]).mapInArrow(run, schema)


def _mean(x: np.ndarray, starts: np.ndarray, feature: np.ndarray, right: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The mean of the leaves that the rows of ``x`` reach, added up tree after tree."""
    total, each = np.zeros(len(x)), np.arange(len(x))
    for start in starts:
        at, going = np.full(len(x), start, np.int32), each
        while len(going):
            node = at[going]
            on = feature[node]
            inner = on >= 0
            going, node, on = going[inner], node[inner], on[inner]
            at[going] = np.where(x[going, on] <= value[node], node + 1, right[node])
        total += value[at]
    return total / len(starts)
