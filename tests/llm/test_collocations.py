import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brute import LOWER
from ebbtide.llm.collocations import _spread_counts, collocations, quicksort_counts, word_counts
from ebbtide.llm.scratch import saved


def brute(rows, least, top):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            own.update(tuple(ws[i : i + k]) for k in range(1, 6) for i in range(len(ws) - k + 1))
    out = []
    for lang, own in counts.items():
        found = []
        for p, a in own.items():
            if len(p) < 2 or a < least:
                continue
            if any(own[q] >= a for q in own if len(q) == len(p) + 1 and p in (q[1:], q[:-1])):
                continue
            score, k = min((1000 * a * totals[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "The", "été", "日本", "sea", "tide", "b\x00c", "moon-light", "x" * 300]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!\v"]) for _ in range(n))
    rows = [(text(rng.randint(0, 60)), rng.choice(["en", "en", "de", None, "und"])) for _ in range(120)]
    rows += [(None, "en"), ("", "fr"), (" . ,", "fr"), ("high tide rises " * 300, "en"), ("the the the the the the " * 200, "de"), *rows[:5]]
    return rows


@pytest.mark.parametrize("least,top,group_rows", [(3, 2000, 1 << 18), (4, 7, 20), (2, 40, 3)])
def test_phrases_equal_counting_all(spark, least, top, group_rows):
    rows = corpus(least)
    docs = spark.createDataFrame([(t, lang, 1, "n") for t, lang in rows], "text string, lang string, rank int, ws string").repartition(3)
    ours = sorted(tuple(r) for r in collocations(docs, least, top, group_rows).collect())
    assert ours == brute(rows, least, top)


def test_empty_table_and_no_words(spark):
    for rows in ([], [(None, None), (" ", "en")]):
        assert collocations(spark.createDataFrame(rows, "text string, lang string")).collect() == []


def test_products_past_64_bits(spark):
    big = spark.sql("""SELECT (cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) AS s
        FROM VALUES (3000000000001L, 90000000000007L, 3000000000002L, 3000000000003L) AS t(a, n, l, r)""").first().s
    assert big == 1000 * 3000000000001 * 90000000000007 // (3000000000002 * 3000000000003)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 3), min_size=2, max_size=5), st.integers(1, 4)), min_size=1, max_size=60), st.integers(1, 12))
def test_equal_parts_of_the_quicksort_are_counts(rows, least):
    words = np.array([ws + [0] * (5 - len(ws)) for ws, _ in rows], np.uint64)
    weights = np.array([n for _, n in rows])
    want = Counter()
    for ws, n in rows:
        want.update({tuple(ws[:k]): n for k in range(2, len(ws) + 1)})
    two = np.full(len(rows), 2)
    got = {tuple(words[r, :k].tolist()): n for r, k, n in quicksort_counts(words, weights, two, least)}
    assert got == {p: n for p, n in want.items() if n >= least}
    # Suffixes that begin with 1 are routed by three words: their pairs are counted apart.
    depths = np.where(words[:, 0] == 1, 3, 2)
    parts = list(quicksort_counts(words, weights, depths, 1)) + list(_spread_counts(words, weights, depths))
    assert len(parts) == len(want) and {tuple(words[r, :k].tolist()): n for r, k, n in parts} == dict(want)


class _Pass:
    """Takes the place of a table: keeps the function that Spark would run on it."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def groupBy(self, *_):
        return self

    agg = groupBy


def test_a_pass_folds_few_occurrences_at_once(spark):
    words = np.random.default_rng(6).integers(0, 40_000, 600_000).tolist()
    texts = [" ".join(f"w{k}" for k in words[at : at + 1000]) for at in range(0, len(words), 1000)]
    batch = pa.record_batch([pa.array([5] * len(texts), pa.int64()), pa.array(texts)], ["salt", "text"])
    counts = _Pass()
    word_counts(counts)
    tracemalloc.start()
    total = sum(sum(made.column(2).to_pylist()) for made in counts.run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == len(words) and peak < 25e6


def test_only_phrases_that_are_asked_for_are_written(spark, monkeypatch):
    written = {}

    def recorded(df, name):
        kept = saved(df, name)
        written.setdefault(name, []).extend(tuple(r) for r in kept.collect())
        return kept

    monkeypatch.setattr("ebbtide.llm.collocations.saved", recorded)
    docs = spark.createDataFrame([("a b c. a b d. a b c e f",), ("f a. e a. d a. c b a b c",)], "text string").selectExpr("text", "'en' lang")
    assert collocations(docs, least=2).count()
    assert written["leads"] and min(n for _, n in written["leads"]) >= 2
