import random

import numpy as np
import pytest

from brute import near_duplicate_classes, shingles
from ebbtide.llm import near_dedup
from ebbtide.llm.components import components
from ebbtide.llm.near_dedup import SKETCH_BITS, _differing_alike, near_duplicates, odd_sketch, signature


def edited(rng, text, times):
    out = list(text)
    for _ in range(times):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = {}
    for k in range(150):
        texts[k] = edited(rng, base, rng.choice([1, 2, 3, 4, 5, 6, 9]))
    for k in range(150, 190):
        texts[k] = edited(rng, texts[k - 1], 2)
    for k in range(190, 230):
        texts[k] = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))]
    for k in range(230, 260):
        texts[k] = list(texts[k - 40])
    rows = {k: " ".join(t) for k, t in texts.items()}
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows.items()], "doc_id long, text string, label string, n int")
    found = {r.doc_id: r for r in near_duplicates(docs).collect()}
    want = near_duplicate_classes(rows)
    assert {k: r.component_id for k, r in found.items()} == want
    assert all(r.kept == (want[k] == k) and r.n_shingles == len(shingles(rows[k], 5)) for k, r in found.items())


def test_defined_results_of_odd_rows(spark):
    rows = [
        (5, None), (6, ""), (7, " \t"), (8, "One"), (9, "one"), (3, "a b c"), (4, "a b c d e f g h"), (2, "A b\nc d e f g h"),
        (2, "A b\nc d e f g h"), (None, "a b c"), (None, "only here"),
    ]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles, r.kept) for r in found) == sorted([
        (5, 5, 0, True), (6, 6, 0, True), (7, 7, 0, True), (8, 8, 1, True), (9, 8, 1, False), (3, 3, 1, True), (4, 2, 4, False),
        (2, 2, 4, True), (2, 2, 4, True), (0, 3, 1, True), (0, 0, 1, True),
    ])


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    a, b = signature(pool[:1000], 2048), signature(pool[500:], 2048)
    assert abs((a == b).mean() - 1 / 3) < 0.05


def test_components_of_a_long_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {k: 0 if k < 100 else 100 for k in [*range(41), *range(100, 160)]}


def test_pairs_with_one_set_in_reach_of_the_hub_are_all_found(spark):
    rng = np.random.default_rng(7)
    fresh = iter(rng.permutation(1 << 20).tolist())

    def edited(base, places):
        out = list(base)
        for k in places:
            out[4 * k : 4 * k + 4] = [next(fresh) for _ in range(4)]
        return out

    hub = [next(fresh) for _ in range(400)]
    rows, labels, wanted = [(0, hub)], {0: 0}, set()
    for k in range(1, 41):
        places = rng.permutation(100)[:12]
        near = edited(hub, places[:1])
        rows += [(k, near), (100 + k, edited(near, places[1:]))]
        labels |= {k: 0, 100 + k: 100 + k}
    for k, one in rows:
        for j, two in rows:
            both = len(set(one) & set(two))
            if 0 < k < j and labels[k] != labels[j] and 100 * both >= 80 * (800 - both):
                wanted.add((k, j))
    mixed = spark.createDataFrame([(1, k, 400, labels[k]) for k, _ in rows], "key long, id long, n long, label long")
    sets = spark.createDataFrame(
        [(k, sorted(s), odd_sketch(np.array(s, np.uint64)).view(np.int64).tolist()) for k, s in rows],
        "id long, shingles array<long>, odd array<long>",
    )
    found = {(r.a, r.b) for r in _differing_alike(mixed, sets, 80).collect()}
    assert {(k, 100 + k) for k in range(1, 41)} <= wanted <= found


def test_sketches_never_differ_more_than_their_sets():
    rng = np.random.default_rng(3)
    for size in (1, 5, 60, 900):
        for gone in (0, 1, 3, size // 3):
            pool = rng.integers(0, 1 << 63, size + gone).astype(np.uint64)
            a, b = odd_sketch(pool[:size]), odd_sketch(pool[gone:])
            bits = sum(int(x).bit_count() for x in a ^ b)
            assert len(a) == SKETCH_BITS // 64 and bits <= 2 * gone and (gone > 0 or bits == 0)
    assert not odd_sketch(np.zeros(0, np.uint64)).any()


def test_only_members_of_different_components_are_compared_again(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"b{k}" for k in range(400)]
    # Near copies, each with one changed word: most buckets have a smallest id of their own.
    rows = {k: " ".join(edited(rng, base, 1)) for k in range(80)}
    asked = []
    confirm = near_dedup._confirmed

    def counted(pairs, sets, percent):
        asked.append(pairs.select("a", "b").collect())
        return confirm(pairs, sets, percent)

    monkeypatch.setattr(near_dedup, "_confirmed", counted)
    # Others share buckets with them and are not similar enough.
    every = rows | {200 + k: " ".join(base[8 * k : 8 * k + 300] + [f"o{k}-{j}" for j in range(100)]) for k in range(12)}
    found = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame([*every.items()], "doc_id long, text string")).collect()}
    assert found == near_duplicate_classes(every)
    again = [r for more in asked[1:] for r in more]
    assert again and not [r for r in again if r.a in rows and r.b in rows]
