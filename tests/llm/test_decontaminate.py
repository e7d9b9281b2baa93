import random

import numpy as np
import pytest

from ebbtide.llm.decontaminate import contaminated, greedy_tiles


def plain_tiling(item, doc, seed):
    """Mark the longest common unmarked run, first in the item, then in the document, until none is left."""
    marked_i, marked_d, tiles = set(), set(), []
    while True:
        best = (seed - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in marked_i and j + n not in marked_d:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < seed:
            return tiles
        marked_i |= set(range(i, i + n))
        marked_d |= set(range(j, j + n))
        tiles.append((i, j, n))


@pytest.mark.parametrize("seed", range(30))
def test_tiles_equal_plain_tiling(seed):
    rng = np.random.default_rng(seed)
    item, doc = rng.integers(0, 3, 25).astype(np.uint64), rng.integers(0, 3, 40).astype(np.uint64)
    assert greedy_tiles(item, doc, 3) == plain_tiling(item.tolist(), doc.tolist(), 3)


def test_reordered_partial_and_clean_documents(spark):
    rng = random.Random(1)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    item = words(40)
    texts = {
        1: words(30) + item + words(9), 2: item[20:] + words(50) + item[:20], 3: item[:10] + words(50), 4: words(300), 5: item[:20],
        6: [w.upper() + "," for w in item],
    }
    rows = [(k, " ".join(t)) for k, t in texts.items()] + [(7, None), (8, ""), (None, " ".join(item)), (1, " ".join(texts[1]))]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, "a b"), (12, None), (None, " ".join(item))], "item_id long, text string")
    found = {r.doc_id: r for r in contaminated(docs, bench).collect()}
    assert set(found) == {1, 2, 5, 6} and all(r.item_id == 10 for r in found.values())
    assert (found[1].tiles, found[1].coverage) == (1, 1.0) and (found[2].tiles, found[2].coverage) == (2, 1.0)
    assert found[5].coverage == 0.5
    assert contaminated(docs.where("false"), bench).count() == 0
    assert contaminated(docs, bench.where("false")).count() == 0
