"""Token counts that follow edits: a segment tree over the pre-tokens of each document.

A leaf holds a run of whole words with the white space after them; no token crosses white
space, so a document's count is the sum of its leaves. The tree holds characters and tokens
of every subtree. An edit touches the leaves it falls into; where it joins words across a
leaf's end, the next leaf's first word is drawn in as context. Only touched leaves are encoded
again, and the sums on their paths to the root follow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.tokens import WordTokenizer, tokenizer_path
from ebbtide.llm.words import chunks, split_words

LEAF_WORDS = 32
#: Documents whose trees are open at a time.
_EDITED_ROWS = 256

_BLANKS = " \t\n\v\f\r"
_FIRST_WORD = re.compile(f"[^{_BLANKS}]+[{_BLANKS}]*")
EDITS = "array<struct<start: int, stop: int, text: string>>"


def subtree_sums(values: list[int]) -> list[int]:
    """Sums of a complete binary tree as a heap: node k has children 2 k and 2 k + 1, leaves lie at the end."""
    size = 1
    while size < len(values):
        size *= 2
    sums = [0] * size + values + [0] * (size - len(values))
    for k in range(size - 1, 0, -1):
        sums[k] = sums[2 * k] + sums[2 * k + 1]
    return sums


class Tree:
    """One document: leaf texts, and sums of characters and tokens by subtree."""

    def __init__(self, text: str, leaf_chars: list[int], token_sums: list[int]) -> None:
        self.leaves, at = [], 0
        for n in leaf_chars:
            self.leaves.append(text[at : at + n])
            at += n
        self.chars = subtree_sums(leaf_chars)
        self.tokens = token_sums
        self.touched: set[int] = set()

    def leaf_at(self, char: int) -> tuple[int, int]:
        """Leaf of a character position and the position in it; the end belongs to the last leaf."""
        size, k = len(self.chars) // 2, 1
        while k < size:
            k *= 2
            if char >= self.chars[k] and self.chars[k + 1]:
                char -= self.chars[k]
                k += 1
        return k - size, char

    def _set(self, leaf: int, text: str) -> None:
        size = len(self.chars) // 2
        by, k = len(text) - len(self.leaves[leaf]), leaf + size
        self.leaves[leaf] = text
        self.touched.add(leaf)
        while k:
            self.chars[k] += by
            k //= 2

    def edit(self, start: int, stop: int, text: str) -> None:
        """Replace the characters [start, stop), clipped to the text, by ``text``."""
        if not self.leaves:
            self.leaves, self.chars, self.tokens = [""], [0, 0], [0, 0]
        start = min(max(start, 0), self.chars[1])
        stop = min(max(stop, start), self.chars[1])
        (first, a), (last, b) = self.leaf_at(start), self.leaf_at(stop)
        tail = self.leaves[last][b:]
        for leaf in range(first + 1, last + 1):
            self._set(leaf, "")
        self._set(first, self.leaves[first][:a] + text + tail)
        self._join(first)
        before = next((k for k in range(first - 1, -1, -1) if self.leaves[k]), None)
        if before is not None and self.leaves[before][-1] not in _BLANKS:
            self._join(before)

    def _join(self, leaf: int) -> None:
        """Draw in following words while the leaf does not end in white space."""
        for k in range(leaf + 1, len(self.leaves)):
            mine = self.leaves[leaf]
            if not mine or mine[-1] in _BLANKS:
                return
            if self.leaves[k]:
                found = _FIRST_WORD.match(self.leaves[k])
                taken = found.end() if found else 0
                if not taken:
                    return
                self._set(leaf, mine + self.leaves[k][:taken])
                self._set(k, self.leaves[k][taken:])

    def counted(self, leaf: int, tokens: int) -> None:
        k = leaf + len(self.tokens) // 2
        by = tokens - self.tokens[k]
        while k:
            self.tokens[k] += by
            k //= 2

    @property
    def text(self) -> str:
        return "".join(self.leaves)


def _leaf_bounds(data: np.ndarray, rows: np.ndarray, leaf_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of all leaves of a chunk, and the leaves of each row."""
    words = split_words(data, rows)
    inner = np.arange(len(words.starts)) - np.repeat(words.bounds[:-1], np.diff(words.bounds))
    cuts = words.starts[(inner % leaf_words == 0) & (inner > 0)]
    bounds = np.unique(np.concatenate([rows, cuts]))
    return bounds, np.searchsorted(bounds, rows)


_TREE = "leaf_chars array<int>, tokens array<int>"


def token_trees(docs: DataFrame, leaf_words: int = LEAF_WORDS, path: str | None = None) -> DataFrame:
    """``docs`` with leaf_chars, the characters of each leaf, and tokens, the sums of the tree as a heap.

    tokens[1] is the count of the whole text. Null and empty texts have no leaf and the sums
    [0, 0]. Columns of these two names are replaced; all others are kept.
    """
    path = path or tokenizer_path()
    docs = docs.drop("leaf_chars", "tokens")
    columns = docs.columns
    place = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordTokenizer.of(path)
        kind = pa.list_(pa.int32())
        for batch in batches:
            for first, end, data, rows in chunks(batch.column(place)):
                sizes, sums = [], []
                bounds, of_row = _leaf_bounds(data, rows, leaf_words)
                tokens = np.diff(encoder.encode(data, bounds).bounds)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                chars = np.diff(points[bounds])
                for a, b in zip(of_row[:-1], of_row[1:]):
                    sizes.append(chars[a:b])
                    sums.append(subtree_sums(tokens[a:b].tolist()))
                own = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(sizes, kind), pa.array(sums, kind)], [*columns, "leaf_chars", "tokens"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), _TREE])
    return docs.mapInArrow(run, schema)


def apply_edits(trees: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text, leaf_chars, tokens, tokens_before, tokens_after, encoded_chars) of rows of ``token_trees`` with ``edits``.

    ``edits`` is an array of (start, stop, text) in characters, applied in order, each to the
    text as the ones before left it; positions beyond the text are clipped, null edits,
    positions and texts count as none, 0 and empty. ``encoded_chars`` counts the characters of
    the leaves that were encoded again. Rows without edits keep their tree.
    """
    path = path or tokenizer_path()
    schema = "doc_id long, text string, leaf_chars array<int>, tokens array<int>, tokens_before long, tokens_after long, encoded_chars long"
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordTokenizer.of(path)
        kind = pa.list_(pa.int32())
        for batch in (b.slice(at, _EDITED_ROWS) for b in batches for at in range(0, b.num_rows, _EDITED_ROWS)):
            trees_of = []
            for text, leaves, tokens, edits in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4))):
                tree = Tree(text or "", leaves, tokens)
                trees_of.append((tree, tokens[1]))
                for e in edits or []:
                    if e is not None:
                        tree.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
            dirty = [(tree, leaf) for tree, _ in trees_of for leaf in sorted(tree.touched)]
            at = 0
            for _, _, data, rows in chunks(pa.array([tree.leaves[leaf] for tree, leaf in dirty], pa.string())):
                for n in np.diff(encoder.encode(data, rows).bounds).tolist():
                    dirty[at][0].counted(dirty[at][1], n)
                    at += 1
            columns = [
                batch.column(0), pa.array([t.text for t, _ in trees_of], pa.string()),
                pa.array([[len(x) for x in t.leaves] for t, _ in trees_of], kind), pa.array([t.tokens for t, _ in trees_of], kind),
                pa.array([n for _, n in trees_of], pa.int64()), pa.array([t.tokens[1] for t, _ in trees_of], pa.int64()),
                pa.array([sum(len(t.leaves[k]) for k in t.touched) for t, _ in trees_of], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return trees.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "leaf_chars", "tokens", F.col("edits").cast(EDITS).alias("edits")).mapInArrow(run, schema)
