import random

from tokenizers import Tokenizer

from ebbtide.llm.token_trees import apply_edits, subtree_sums, token_trees
from ebbtide.llm.tokens import tokenizer_path

ALPHABET = ["tide ", "ebb", " ", "\n", "é", ". ", "it's", "\t\t", "日本", "<|endoftext|>", "12"]


def test_counts_equal_full_encoding_after_any_edits(spark):
    encoder = Tokenizer.from_file(tokenizer_path())
    count = lambda t: len(encoder.encode(t, add_special_tokens=False).ids)
    rng = random.Random(7)
    rows, want = [], {}
    for k in range(120):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 150)))
        edits, now = [], text
        for _ in range(rng.randrange(0, 8)):
            a = rng.randrange(0, len(now) + 2)
            b = a + rng.choice([0, 0, 1, 3, 60])
            put = "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 3])))
            edits.append((a, b, put))
            now = now[:a] + put + now[max(a, b):]
        rows.append((k, text, edits, "x"))
        want[k] = (now, count(text), count(now))
    rows += [(500, None, [(0, 0, "new words")], "x"), (501, "", None, "x"), (502, "a b", [None, (None, None, None)], "x")]
    want |= {500: ("new words", 0, 2), 501: ("", 0, 0), 502: ("a b", 2, 2)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,stop:int,text:string>>, position string")
    for r in apply_edits(token_trees(docs, leaf_words=3)).collect():
        assert (r.text, r.tokens_before, r.tokens_after) == want[r.doc_id]
        assert sum(r.leaf_chars) == len(r.text) and r.tokens[1] == r.tokens_after
        leaves = r.tokens[len(r.tokens) // 2 :]
        assert subtree_sums(leaves)[1:] == r.tokens[1:]
    assert apply_edits(token_trees(docs.where("false"))).count() == 0


def test_small_edits_encode_little(spark):
    docs = spark.createDataFrame([(1, "tide and ebb " * 20_000)], "doc_id long, text string").selectExpr(
        "*", "array(named_struct('start', 1000, 'stop', 1004, 'text', 'flow')) AS edits"
    )
    (row,) = apply_edits(token_trees(docs)).collect()
    phrase = Tokenizer.from_file(tokenizer_path()).encode("tide and ebb", add_special_tokens=False).ids
    assert row.encoded_chars < 200 and row.tokens_before == 20_000 * len(phrase)
