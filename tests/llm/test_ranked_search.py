import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brute import LOWER
from ebbtide.llm import ranked_search as search
from ebbtide.llm.ranked_search import ranked_search, tail_bounds

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top):
    held = [(k, Counter(terms(t))) for k, t in docs if terms(t)]
    total, words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2.0 * total + 2) / (2.0 * n + 1))) for t, n in df.items()}
    out = []
    for item in sorted({k for k, _ in items if k is not None}):
        asked = {t for k, text in items if k == item for t in terms(text)}
        scores = []
        for k, c in held:
            m = 50 + 50 * sum(c.values()) * total // words
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if score > 0:
                scores.append((-score, k is None, k if k is not None else 0))
        out += [(item, r, None if none else k, -s) for r, (s, none, k) in enumerate(sorted(scores)[:top], 1)]
    return out


def tables(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(2000)] + ["Été", "日本", "tide2", "A"]
    text = lambda k: "".join(rng.choice(words) + rng.choice([" ", ", ", "-", "_", "\n", "\x00"]) for _ in range(k))
    docs = [(k, text(rng.randint(0, 60))) for k in range(n)] + [(n, None), (n + 1, ""), (n + 2, " .!"), (None, text(20)), (None, text(30)), (n + 3, text(30_000))]
    docs += [docs[5], docs[5], (7, text(10)), *[(1000 + k, docs[9][1]) for k in range(40)]]
    items = [(k, text(rng.randint(1, 25))) for k in range(12)] + [(50, None), (51, "..."), (None, text(5)), (3, text(4)), (52, docs[9][1]), (53, "nowhere w1"), (54, "w1")]
    return docs, items


@pytest.mark.parametrize("top,docs_of_a_block,query_terms", [(50, 4096, 1 << 18), (5, 16, 40)])
def test_results_equal_scoring_all(spark, top, docs_of_a_block, query_terms):
    docs, items = tables(top)
    frame = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, term string, score int").repartition(3)
    asked = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, docs int")
    ours = [tuple(r) for r in ranked_search(frame, asked, top, query_terms, docs_of_a_block).orderBy("item_id", "rank").collect()]
    assert ours == brute(docs, items, top)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a c")], "item_id long, text string")
    assert ranked_search(docs.limit(0), items).collect() == [] == ranked_search(docs, items.limit(0)).collect()
    assert [tuple(r)[:3] for r in ranked_search(docs, items).collect()] == [(1, 1, 1)]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 7).flatmap(lambda n: st.lists(st.lists(st.integers(0, 9), min_size=n, max_size=n), min_size=1, max_size=12)))
def test_pair_bounds_hold_and_tighten(gains):
    gains = np.array(gains)  # of documents in rows, terms in columns; 0: not there
    most = gains.max(axis=0)
    both = (gains[:, :-1] > 0) & (gains[:, 1:] > 0)
    joint = np.where(both, gains[:, :-1] + gains[:, 1:], 0).max(axis=0)
    pair = np.maximum(joint, np.maximum(most[:-1], most[1:]))
    bounds = tail_bounds(most, pair)
    for k in range(len(most) + 1):
        assert gains[:, k:].sum(axis=1).max() <= bounds[k] <= most[k:].sum()


def test_blocks_and_documents_are_skipped(spark):
    rows = [(k, ("common " if k < 500 else "other ") * 3 + f"x{k} " * 5) for k in range(1000)] + [(k, "common rare odd") for k in range(1000, 1060)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    asked = search.item_terms(spark.createDataFrame([(1, "common rare odd")], "item_id long, text string"))
    blocks = search.posting_blocks(docs, asked.select("term"), 50)
    weights = asked.join(search.term_weights(blocks, len(rows)), "term").select("item_id", "term", "weight").orderBy("item_id", "weight", ascending=[True, False])
    queries = search._queries(weights.collect())
    (batch,) = search.impact_index(blocks, queries, len(rows), sum(len(t.split()) for _, t in rows)).toArrow().combine_chunks().to_batches()
    made = [search.Block(batch, row, queries) for row in range(batch.num_rows)]
    assert [b.size for b in made] == [50] * 21 + [10]
    # The 50 documents of the last full block hold the rare pair; its list alone gives a score they all reach.
    guess = made[-2].first_guess(queries.terms, queries.pair_of[:-1], 50)
    found, scores = made[-2].best(queries, 0, 0, 50)
    assert len(found) == 50 and max(0, made[0].most.max()) < guess <= scores.min()
    # Bounds of pairs: where the rare terms are missing a block is not read at all.
    assert len(made[0].best(queries, 0, int(scores.min()), 50)[0]) == 0 and len(made[0].best(queries, 0, 0, 50)[0]) == 50
