import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from brute import shingles, words
from ebbtide.llm.words import chunks, prefix_hashes, shingle_hashes, split_words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aAbB \t\n\x0b\x0cé日.\x00", max_size=30)), max_size=8), st.integers(1, 40))
def test_words_and_shingles_of_any_rows(texts, limit):
    seen, of_hash = {}, {}
    for first, end, data, rows in chunks(pa.array(texts, pa.string()), limit):
        made = split_words(data, rows)
        hashes, at = shingle_hashes(made, 2)
        for r in range(end - first):
            lo, hi = made.bounds[r], made.bounds[r + 1]
            own = [bytes(data[s:e]).decode() for s, e in zip(made.starts[lo:hi], made.ends[lo:hi])]
            assert [w.lower() if w.isascii() else w.replace("A", "a").replace("B", "b") for w in own] == words(texts[first + r])
            for word, h in zip(words(texts[first + r]), made.hashes[lo:hi]):
                assert seen.setdefault(word, h) == h and of_hash.setdefault(h, word) == word
            assert len(set(hashes[at[r] : at[r + 1]])) == (len(shingles(texts[first + r], 2)) if hi - lo > 1 else 0)


def test_sliced_and_empty_columns():
    column = pa.array(["x y", "a b c", None, "d"]).slice(1, 3)
    ((_, _, data, rows),) = chunks(column)
    assert np.diff(split_words(data, rows).bounds).tolist() == [3, 0, 1]
    assert list(chunks(pa.array([], pa.string()))) == []


def test_prefixes_agree_between_words():
    ((_, _, data, rows),) = chunks(pa.array(["tidal tide ti Tidings"]))
    made = split_words(data, rows)
    longer, hashes = prefix_hashes(made, 3)
    assert longer.tolist() == [0, 1, 3] and len(set(hashes.tolist())) == 1
