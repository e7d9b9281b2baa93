import numpy as np
import pytest

from ebbtide.llm import topk
from ebbtide.llm.topk import integer_vectors, threshold_search, top_k


def brute(ids, vectors, own, query, k):
    scores = [(-int(v @ query), int(i)) for i, v in zip(ids, vectors) if i != own]
    return [(i, -s) for s, i in sorted(scores)[:k]]


@pytest.mark.parametrize("seed", range(6))
def test_search_with_ties_and_zeros(seed):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-3, 4, (rng.integers(1, 200), 4))
    ids = rng.permutation(1000)[: len(vectors)]
    order = np.argsort(vectors, axis=0).T
    for query in [*rng.integers(-3, 4, (20, 4)), np.zeros(4, np.int64)]:
        names, scores, _ = threshold_search(query, int(ids[0]), ids, vectors, order, 5)
        assert list(zip(names.tolist(), scores.tolist())) == brute(ids, vectors, ids[0], query, 5)


def test_search_stops_early_on_skewed_values():
    rng = np.random.default_rng(0)
    vectors = (rng.pareto(1.2, (20_000, 3)) * 10).astype(np.int64)
    order = np.argsort(vectors, axis=0).T
    *_, scored = threshold_search(np.array([1, 1, 1]), -1, np.arange(20_000), vectors, order, 5)
    assert scored < 2_000


def test_blocks_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 7)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(size=3)]) for k in range(60)]
    rows += [(100, None), (101, [1.0, None, 0.0]), (102, [float("nan"), 0.0, 1.0]), (103, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (59, rows[59][1]), (104, [])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    vectors = integer_vectors(table, "vec_id", "embedding", 256)
    found = top_k(vectors.where("id % 10 = 0"), vectors, 5).orderBy("query_id", "rank").collect()
    ids = np.arange(60)
    whole = np.array([np.floor(256 * np.float32(r[1]).astype(float)) for r in rows[:60]]).astype(np.int64)
    want = [(q, n + 1, i, s) for q in range(0, 60, 10) for n, (i, s) in enumerate(brute(ids, whole, q, whole[q], 5))]
    assert [tuple(r) for r in found] == want
    assert top_k(vectors.where("false"), vectors, 5).count() == 0
    assert top_k(vectors, vectors.where("id < 2"), 5).where("query_id < 2").count() == 2
