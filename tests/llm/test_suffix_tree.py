import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from brute import words
from ebbtide.llm import suffix_tree
from ebbtide.llm.suffix_tree import DEPTH, Tree, canonical, fit_tree, place_codes, score_texts
from ebbtide.llm.words import chunks, split_words


def sequence(text):
    return b"".join(w.encode() + b" " for w in words(text)) + b"\n"


def test_base_scores_equal_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 100_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(10_001, None), (10_002, ""), (10_003, "unseen zzzqq"), (10_003, "unseen zzzqq"), (None, "Only unseen")], "doc_id long, text string")
    table = docs.select("doc_id", "text").union(extra)
    counts, rows = Counter(), table.collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 if r.doc_id is not None else None for r in rows}
    for r in rows:
        if held[r.doc_id] is False:
            counts.update([*words(r.text), None])
    n, v = sum(counts.values()), len(counts)
    found = score_texts(table.selectExpr("*", "1 AS score", "2 AS block")).collect()
    assert len(found) == len(rows)
    text_of = {r.doc_id: r.text for r in rows}
    for r in found:
        tokens = [*words(text_of[r.doc_id]), None]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, -base) and r.score <= 0


def test_held_out_texts_score_above_their_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    row = score_texts(docs).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert row[0] > row[1]


def test_distributions_sum_to_one_and_follow_longest_state(spark):
    texts = ["abab abab abac"] * 50 + ["xy", None]
    tree = fit_tree(spark.createDataFrame([(t,) for t in texts], "text string"), share=1e-3)
    for context in (b"\n" * DEPTH, b"ba\n\n\n\n", b"abab a", b"zzzzzz"):
        head = np.uint64(int.from_bytes(context, "big")) << np.uint64(8)
        p = tree.probabilities(head + np.arange(256, dtype=np.uint64))
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()
    after = lambda context: tree.probabilities((np.uint64(int.from_bytes(context[::-1], "big")) << np.uint64(8)) + np.arange(256, dtype=np.uint64))
    assert after(b"b abab")[ord(" ")] > 0.9 and any(len(c) for c in tree.contexts)


def test_states_need_divergence(spark):
    rng = np.random.default_rng(3)
    texts = [("".join(rng.choice(list("abcd"), 400)),) for _ in range(60)]
    tree = fit_tree(spark.createDataFrame(texts, "text string"), share=1e-4)
    # Random letters: contexts of two or three letters say nothing, and most of the rare long ones go too.
    assert sum(len(c) for c in tree.contexts[1:3]) < 10
    assert sum(len(c) for c in tree.contexts) < 0.25 * sum(4**k for k in range(1, DEPTH + 1))


def test_sequences_and_codes():
    texts = ["A b", "", None, " cd\t\n e ", "É"]
    ((_, _, data, rows),) = chunks(pa.array(texts))
    made, at = canonical(split_words(data, rows))
    assert [bytes(made[a:b]) for a, b in zip(at[:-1], at[1:])] == [sequence(t) for t in texts]
    codes = place_codes(made, at)
    for a, b in zip(at[:-1], at[1:]):
        own = b"\n" * DEPTH + bytes(made[a:b])
        for k in range(b - a):
            assert int(codes[a + k]) == int.from_bytes(own[k : k + DEPTH][::-1] + own[k + DEPTH : k + DEPTH + 1], "big")


def test_empty_table(spark):
    assert score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only_held = spark.createDataFrame([(k, "a b") for k in range(40) if zlib.crc32(str(k).encode()) % 7 == 2], "doc_id long, text string")
    assert all((r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0) for r in score_texts(only_held).collect())


def test_states_do_not_depend_on_table_size_and_are_joined(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 100_000)
    monkeypatch.setattr(suffix_tree, "GROUP_BYTES", 50_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    tree = fit_tree(docs.where("crc32(cast(doc_id AS string)) % 7 <> 2").select("text"))
    assert min(t.min() for t in tree.totals if len(t)) < 10
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in score_texts(docs).collect():
        ((_, _, data, rows),) = chunks(pa.array([texts[r.doc_id]]), 1 << 30)
        score = np.log10(tree.probabilities(place_codes(*canonical(split_words(data, rows))))).sum()
        assert abs(r.score - score) < 1e-5 * max(1, -score)
    # 15 million places: a share of 2e-7 would ask for three occurrences.
    level = spark.createDataFrame([(int.from_bytes(b"zyxwvu" + b"a", "big"), 2), (int.from_bytes(b"abcdef" + b"b", "big"), 14_999_998)], "code long, n long")
    assert [r.n for r in suffix_tree.tree_levels(level, 15_000_000)[1].where("state").collect()] == [2]


def test_chained_probabilities_follow_the_definition():
    rng = np.random.default_rng(9)
    text = "".join(rng.choice(["ab", "abc ", "the ", "then ", "xy"], 900))
    data = np.frombuffer(text.encode(), np.uint8)
    codes, n = np.unique(place_codes(data, np.array([0, len(data)])), return_counts=True)
    n[::7] = 0
    counts = Counter()
    for code, times in zip(codes.tolist(), n.tolist()):
        whole = code.to_bytes(DEPTH + 1, "big")
        for depth in range(DEPTH + 1):
            counts[whole[:depth], whole[DEPTH]] += times
    after = {}
    for (context, byte), times in counts.items():
        after.setdefault(context, {})[byte] = times

    def probability(context, byte):
        if not context:
            return (after[b""].get(byte, 0) + 1) / (sum(after[b""].values()) + 256)
        shorter = probability(context[:-1], byte)
        own, up = after[context], after[context[:-1]]
        total, up_total = sum(own.values()), sum(up.values())
        gain = sum(k * math.log(k / total / (up[b] / up_total)) for b, k in own.items() if k)
        kinds = sum(k > 0 for k in own.values())
        if total >= suffix_tree.LEAST and gain > 0.5 * kinds * math.log(total) + suffix_tree._EVEN:
            return (own.get(byte, 0) + suffix_tree.WEIGHT * shorter) / (total + suffix_tree.WEIGHT)
        return shorter

    first = np.zeros((256, 256), np.int64)
    np.add.at(first, ((codes >> np.uint64(8 * DEPTH)).astype(int), (codes & np.uint64(255)).astype(int)), n)
    pair = codes >> np.uint64(8 * DEPTH - 8)
    for own in np.unique(pair):
        mine = pair == own
        found = suffix_tree.probabilities_of(codes[mine], n[mine], first)
        wanted = [probability(c.to_bytes(DEPTH + 1, "big")[:DEPTH], c & 255) for c in codes[mine].tolist()]
        assert np.allclose(found, wanted, rtol=1e-12)
