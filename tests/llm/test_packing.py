import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ebbtide.llm.packing import best_fit_decreasing, dual_bound, pack_documents
from ebbtide.llm.tokens import WordTokenizer, tokenizer_path
from ebbtide.llm.words import chunks

TEXTS = [
    None, "", "  \t ", "one", "It's a.b?! 'Tis THE \x00 end...", "<|endoftext|> x<|ENDOFTEXT|>y", "É́ a ́b a.́ Σας ΣΑΣ İx",
    "\x1c a\x1cb  c d", "word. word, word; word: don't we'll", "日本語 ١٢٣ ²x 12.5", "ab " * 5000, "x" * 3000,
]


def brute(text):
    encoder = Tokenizer.from_file(tokenizer_path())
    return encoder.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, expected, capacity):
    pieces = defaultdict(list)
    bins = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(expected)
    for doc, ids in expected.items():
        want = [ids[k : k + capacity] for k in range(0, len(ids), capacity)]
        got = sorted(pieces[doc], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in got] == [(k, k * capacity, len(w)) for k, w in enumerate(want)]
        assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(w, "<u4").tobytes()) for w in want]
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_and_gapless_bins(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, offset string")
    rows = pack_documents(docs, capacity=64, group_pieces=20).collect()
    used = check(rows, {k: brute(t) for k, t in enumerate(TEXTS)}, 64)
    assert used >= rows[0].bound


def test_all_documents_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = pack_documents(docs).collect()
    used = check(rows, {r.doc_id: brute(r.text) for r in docs.collect()}, 2048)
    assert used <= 1.02 * rows[0].bound


def test_exchange_between_groups_saves_bins(spark):
    docs = spark.createDataFrame([(k, "a " * (1 + 37 * k % 60)) for k in range(400)], "doc_id long, text string")
    rows = pack_documents(docs, capacity=64, group_pieces=10).collect()
    used = check(rows, {k: brute("a " * (1 + 37 * k % 60)) for k in range(400)}, 64)
    assert used <= 1.12 * rows[0].bound


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.length, r.offset) for r in pack_documents(docs).collect()) in (
        [(0, 2, 6), (1, 3, 0), (1, 3, 3)],
    )
    assert pack_documents(docs.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_bound_never_exceeds_the_bins(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 41, 25)
    bins, offsets, free = best_fit_decreasing(lengths, 40)
    assert dual_bound(np.bincount(lengths, minlength=41), 40) <= len(free)
    assert dual_bound(np.bincount([21] * 5, minlength=41), 40) == 5
    assert dual_bound(np.bincount([14] * 5, minlength=41), 40) == 3
    load = np.bincount(bins, weights=lengths)
    assert (load <= 40).all() and ((40 - load) == free).all()


def test_words_are_learned_once_per_process():
    encoder = WordTokenizer(tokenizer_path())
    import pyarrow as pa

    ((_, _, data, rows),) = chunks(pa.array(["tide tide, ebb", "ebb TIDE"]))
    made = encoder.encode(data, rows)
    assert len(encoder._place) == 3
    assert made.ids[made.bounds[1] :].tolist() == brute("ebb TIDE")[:-1]


def test_letters_are_learned_apart_from_any_punctuation():
    encoder = WordTokenizer(tokenizer_path())
    ((_, _, data, rows),) = chunks(pa.array(["tide$ ebb$ tide# ebb# tide ebb"]))
    assert encoder.encode(data, rows).ids.tolist() == brute("tide$ ebb$ tide# ebb# tide ebb")[:-1]
    assert len(encoder._place) == 4


def test_ids_of_random_punctuation_letters_and_marks():
    rng = np.random.default_rng(8)
    signs = [chr(c) for c in range(33, 127)] + list("aeStTé̸́̈ßΣ…—²٣日") + ["'s", "'Re", "'ll", " ", "\x00", "<|endoftext|>"]
    texts = ["".join(rng.choice(signs, 60)) for _ in range(300)]
    encoder = WordTokenizer(tokenizer_path())
    for _, _, data, rows in chunks(pa.array(texts)):
        made = encoder.encode(data, rows)
        assert [made.ids[a:b].tolist() for a, b in zip(made.bounds, made.bounds[1:])] == [brute(t)[:-1] for t in texts]
