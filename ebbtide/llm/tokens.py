"""Token ids of whole texts by a public tokenizer, one encoding per distinct word and process.

The tokenizer drops white space and never lets a token cross it, so ids of a text are the ids
of its words one after the other. Letters and the punctuation after them are separate
pre-tokens too, and are split here so that more words repeat; not before an apostrophe, which
contractions begin with, and not inside special tokens. Words are found as 64-bit hashes
(`words.py`); only those that a worker process has not met yet are encoded, all of a chunk in one call.
"""

from __future__ import annotations

import os
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd

from ebbtide.llm.words import split_words

#: Words that a worker process remembers; beyond it starts anew.
CACHE_WORDS = 400_000

_MARK = "\x00"


def _flags(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_BREAKS = (_flags("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), _flags('.,;:!?"#$%&()*+-/=@[]^_`{}~\\'))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoded(NamedTuple):
    ids: np.ndarray  # int32, of all rows
    bounds: np.ndarray  # ids of row r: bounds[r] to bounds[r + 1]
    word_starts: np.ndarray  # byte position of each word
    word_tokens: np.ndarray  # tokens of each word
    word_bounds: np.ndarray  # words of row r


class WordTokenizer:
    """Ids of rows of text for the word-based tokenizer in ``path``."""

    _kept: dict[str, WordTokenizer] = {}

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._encoder = Tokenizer.from_file(path)
        (self._mark,) = self._encode(_MARK)
        # Special tokens are matched before lower-casing, so their rows are encoded whole.
        self._special = [t.content.encode().lower() for t in self._encoder.get_added_tokens_decoder().values()]
        self._clear()

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        """The tokenizer of this process, with the words it has met."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _encode(self, text: str) -> list[int]:
        # The fast form gives the same ids and keeps no offsets.
        return self._encoder.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _clear(self) -> None:
        self._place: dict[int, int] = {}
        self._flat = np.zeros(1 << 16, np.int32)
        self._start = np.zeros(1 << 14, np.int64)
        self._count = np.zeros(1 << 14, np.int64)
        self._used = 0

    def _learn(self, hashes: list[int], words: list[bytes]) -> np.ndarray:
        """The new places of ``words``."""
        odd = [k for k, w in enumerate(words) if b"\x00" in w]
        apart = set(odd)
        plain = [k for k in range(len(words)) if k not in apart] if odd else range(len(words))
        text = f" {_MARK} ".encode().join([words[k] for k in plain] if odd else words).decode("utf-8", "replace")
        ids = np.array(self._encode(text), np.int32)
        cuts = np.flatnonzero(ids == self._mark)
        parts = [np.array(self._encode(words[k].decode("utf-8", "replace")), np.int32) for k in odd]
        sizes = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1 if len(plain) else np.zeros(0, np.int64)
        sizes = np.concatenate([sizes, np.array([len(p) for p in parts], np.int64)])
        first = len(self._place)
        need, rows = self._used + int(sizes.sum()), first + len(words)
        while need > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        while rows > len(self._start):
            self._start = np.concatenate([self._start, np.zeros_like(self._start)])
            self._count = np.concatenate([self._count, np.zeros_like(self._count)])
        self._flat[self._used : need] = np.concatenate([np.delete(ids, cuts), *parts])
        self._start[first:rows] = self._used + np.concatenate([[0], np.cumsum(sizes[:-1])])
        self._count[first:rows] = sizes
        self._used = need
        places = np.arange(first, rows)
        if odd:
            places[[*plain, *odd]] = np.arange(first, rows)
        self._place.update(zip(hashes, places.tolist()))
        return places

    def encode(self, data: np.ndarray, rows: np.ndarray) -> Encoded:
        """Ids of the rows of one chunk of UTF-8 bytes."""
        words = split_words(data, rows, _BREAKS)
        codes, distinct = pd.factorize(words.hashes)
        at = np.zeros(len(distinct), np.int64)
        if len(distinct):
            if len(self._place) + len(distinct) > CACHE_WORDS:
                self._clear()
            at = np.fromiter(map(self._place.get, keys := distinct.tolist(), repeat(-1)), np.int64, len(keys))
            new = np.flatnonzero(at < 0).tolist()
            if new:
                first = np.empty(len(distinct), np.int64)
                first[codes[::-1]] = np.arange(len(codes))[::-1]
                raw = data.tobytes()
                spans = zip(words.starts[first[new]].tolist(), words.ends[first[new]].tolist())
                at[new] = self._learn([keys[k] for k in new], [raw[a:b] for a, b in spans])
        place = at[codes]
        counts = self._count[place]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self._flat[np.repeat(self._start[place] - (ends - counts), counts) + np.arange(total)]
        upto = np.concatenate([[0], ends])
        out = Encoded(ids, upto[words.bounds], words.starts, counts, words.bounds)
        return self._with_special(data, rows, out)

    def _with_special(self, data: np.ndarray, rows: np.ndarray, plain: Encoded) -> Encoded:
        raw = data.tobytes().lower()
        if not any(s in raw for s in self._special):
            return plain
        parts, counts = [], plain.word_tokens.copy()
        for r in range(len(rows) - 1):
            own = plain.ids[plain.bounds[r] : plain.bounds[r + 1]]
            if any(s in raw[rows[r] : rows[r + 1]] for s in self._special):
                own = np.array(self._encode(data[rows[r] : rows[r + 1]].tobytes().decode("utf-8", "replace")), np.int32)
            parts.append(own)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return Encoded(np.concatenate(parts), bounds, plain.word_starts, counts, plain.word_bounds)
