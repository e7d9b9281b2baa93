import random

import numpy as np
import pytest

from ebbtide.llm import toxicity
from ebbtide.llm.toxicity import fit_toxicity, predict_toxicity, score_toxicity, swapped


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    hit = np.array(labels) == 1
    return (order[hit].sum() - hit.sum() * (hit.sum() - 1) / 2) / (hit.sum() * (~hit).sum())


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(found.score, found.toxic) > 0.93
    caught = found[found.predicted == 1]
    assert caught.toxic.mean() > 0.85 and len(caught) > 0.7 * found.toxic.sum()


def test_swapped_copies():
    assert swapped("A Gay man", ["gay", "black", "white", "asian"]) == ["A black man", "A white man"]
    assert swapped("nobody", ["gay", "black"]) == [] and swapped("gay", []) == [] and swapped("gay", ["gay"]) == []


def test_penalty_spares_neutral_mentions(spark):
    rng = random.Random(0)
    filler = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(30))
    rows = [(f"{filler()} muslim {'idiot' if k % 3 else ''}", 1) for k in range(150)] + [(filler(), 0) for _ in range(600)]
    labelled = spark.createDataFrame(rows, "text string, toxic int").coalesce(2)
    texts = spark.createDataFrame([(1, "a muslim wrote this"), (2, "an idiot wrote this"), (3, None), (4, "")], "doc_id long, text string")
    biased = {r.doc_id: r.score for r in predict_toxicity(texts, fit_toxicity(labelled, penalty=0.0)).collect()}
    fair = {r.doc_id: r.score for r in predict_toxicity(texts, fit_toxicity(labelled)).collect()}
    assert biased[1] > 0.5 and fair[1] < 0.5 * biased[1]
    assert fair[2] > 0.5 and fair[3] == fair[4] < 0.3


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    found = score_toxicity(docs, labels).collect()
    assert len(found) == 4 and all(0 <= r.score <= 1 for r in found)
    assert score_toxicity(docs.where("false"), labels).count() == 0


@pytest.mark.parametrize("rows", [0, 10, 24_000, 24_001, 10**9, 10**10, 10**12, 10**14])
def test_the_sample_has_its_size_at_any_number_of_labels(rows):
    assert toxicity._draw_limit(24_000, rows) / toxicity._DRAWS * rows == pytest.approx(min(rows, 24_000), rel=1e-3)

