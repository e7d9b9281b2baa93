"""Phrases of a corpus that stick together, by multikey quicksort of suffixes.

A suffix is a place in a text with the words that follow it in its piece. Words, then leading
pairs and triples, are counted over the whole corpus, and a suffix ends where a rare one
begins: no phrase across it can be frequent. The suffixes are routed by their leading words to
groups of bounded size, by two words or, where those are too common, by more. In each group a
three-way quicksort takes word after word as its key down to the greatest length: the weight of
an equal part is the count of its phrase, and parts below the least count are abandoned.

Words are 64-bit hashes of language and word; bit maps of fixed size carry the counted words
and pairs to the tasks, and what they let through wrongly is only counted in vain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.llm.membership import bit_array, passes
from ebbtide.llm.scratch import forget, saved
from ebbtide.llm.words import chunks, mix, split_words

LONGEST, LEAST, TOP = 5, 100, 2000
#: A leading phrase with more occurrences is routed by one word more; also about the rows of a group.
GROUP_ROWS = 1 << 18
#: Occurrences that a task folds before it hands them on, which bounds a worker's memory.
FOLD = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]


def _flags(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_ENDS = _flags(".,;:!?\n\v\f\r")
_GAPS = _ENDS | _flags(" \t")


@dataclass
class Known:
    """What earlier passes say of the corpus, as bit maps."""

    words: np.ndarray
    #: By length: phrases that are frequent. No suffix goes on across one that is not.
    frequent: dict[int, np.ndarray] = field(default_factory=dict)
    #: By length: phrases whose suffixes are routed by one word more.
    common: dict[int, np.ndarray] = field(default_factory=dict)


def _places(data: np.ndarray, rows: np.ndarray, salts: np.ndarray):
    """Word keys of a chunk, whether the next word goes on in the same piece, and the split itself."""
    words = split_words(data, rows, gaps=_GAPS)
    keys = mix(words.hashes + np.repeat(salts, np.diff(words.bounds)))
    ended = np.cumsum(_ENDS[data], dtype=np.int32)
    before = ended[words.starts] if len(keys) else np.zeros(0, np.int32)
    on = np.zeros(len(keys), bool)
    on[:-1] = before[1:] == before[:-1]
    on[words.bounds[1:][words.bounds[1:] > 0] - 1] = False
    return keys, on, words


def _shifted(keys: np.ndarray, k: int) -> np.ndarray:
    """The key ``k`` places on; 0 behind the last."""
    out = np.zeros_like(keys)
    out[: len(keys) - k] = keys[k:]
    return out


def _longer(prefix: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one word more."""
    return mix(prefix * _BASE + key)


def _over_chunks(docs: DataFrame, schema: str, work: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]], fold) -> DataFrame:
    """Columns of ``work`` over all chunks of (salt, text), gathered to about FOLD rows and folded."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            salts = np.asarray(batch.column(0)).view(np.uint64)
            for first, end, data, rows in chunks(batch.column(1)):
                columns = work(data, rows, salts[first:end])
                held.append(columns)
                size += len(columns[0])
                if size >= FOLD:
                    yield made(held)
                    held, size = [], 0
        if size:
            yield made(held)

    def made(held) -> pa.RecordBatch:
        columns = fold([np.concatenate(c) for c in zip(*held)])
        return pa.RecordBatch.from_arrays([_arrow(c) if isinstance(c, np.ndarray) else c for c in columns], names)

    return docs.mapInArrow(run, schema)


def _arrow(column: np.ndarray) -> pa.Array:
    return pa.array(column.view(np.int64) if column.dtype == np.uint64 else column)


def _fold_keys(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Equal rows of the columns once, with their number; the first column tells most rows apart.

    Rows with equal first column that differ elsewhere may stay in several parts, which are summed later.
    """
    order = np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(fresh)
    return [*[c[at] for c in columns], np.diff(np.append(at, len(order)))]


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, salt, n): occurrences of every word of (salt, text)."""

    def work(data, rows, salts):
        keys, _, words = _places(data, rows, salts)
        return [keys, np.repeat(salts, np.diff(words.bounds))]

    return _over_chunks(docs, "key long, salt long, n long", work, _fold_keys).groupBy("key", "salt").agg(F.sum("n").alias("n"))


def _leads(keys: np.ndarray, on: np.ndarray, known: Known, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the phrase of ``length`` words at each place, and whether all shorter ones within are frequent, as counted."""
    good = passes(known.words, keys)
    keep, prefix = on & good & _shifted(good, 1), _longer(keys, _shifted(keys, 1))
    for k in range(2, length):
        if k in known.frequent:
            at = np.flatnonzero(keep)
            keep[at] = passes(known.frequent[k], prefix[at])
        keep &= _shifted(keep, 1)
        prefix = _longer(prefix, _shifted(keys, k))
    return prefix, keep


def lead_counts(docs: DataFrame, known: Known, length: int) -> DataFrame:
    """(h, n): occurrences of phrases of ``length`` words whose parts are frequent; of four words
    or more, only of those whose suffixes have to be routed by more words."""

    def work(data, rows, salts):
        keys, on, _ = _places(data, rows, salts)
        prefix, keep = _leads(keys, on, known, length)
        for k in range(2, length if length > 3 else 0):
            at = np.flatnonzero(keep)
            keep[at] = passes(known.common[k], _leads(keys, on, known, k)[0][at])
        return [prefix[keep]]

    return _over_chunks(docs, "h long, n long", work, _fold_keys).groupBy("h").agg(F.sum("n").alias("n"))


def suffixes(docs: DataFrame, known: Known, groups: int) -> DataFrame:
    """(group, depth, words, n): distinct suffixes of two words or more, those of a fold and group in one row.

    ``words`` holds five for each suffix, 0 behind its end. All suffixes that agree in their first
    ``depth`` words are of one group. There are never more rows than suffixes, at any number of groups.
    """

    def work(data, rows, salts):
        keys, on, _ = _places(data, rows, salts)
        # Places at which the next word, and the next two, belong to a frequent phrase.
        steps = {}
        for k, table in known.frequent.items():
            prefix, steps[k] = _leads(keys, on, known, k)
            at = np.flatnonzero(steps[k])
            steps[k][at] = passes(table, prefix[at])
        at = np.flatnonzero(steps[2])
        wide = np.concatenate([keys, np.zeros(LONGEST, np.uint64)])
        more = np.concatenate([steps[max(steps)], np.zeros(LONGEST, bool)])
        going, columns = np.ones(len(at), bool), [keys[at], wide[at + 1]]
        for k in range(2, LONGEST):
            going &= more[at + k - 2]
            columns.append(np.where(going, wide[at + k], np.uint64(0)))
        return [_whole(columns), *columns]

    def fold(columns):
        _, *rest, n = _fold_keys(columns)
        depth, route = np.full(len(n), 2, np.int32), _longer(rest[0], rest[1])
        prefix, still = route, np.ones(len(n), bool)
        for k in range(2, LONGEST):
            if k not in known.common:
                break
            still &= passes(known.common[k], prefix)
            prefix = _longer(prefix, rest[k])
            depth[still] = k + 1
            route = np.where(still, prefix, route)
        group = (route % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        at = np.flatnonzero(np.diff(group[order], prepend=-1))
        bounds = np.append(at, len(order)).astype(np.int32)
        words = np.column_stack(rest)[order].ravel()
        lists = [(bounds, depth[order]), (bounds * LONGEST, words), (bounds, n[order])]
        return [group[order][at], *[pa.ListArray.from_arrays(pa.array(b), _arrow(c)) for b, c in lists]]

    return _over_chunks(docs, "group long, depth array<int>, words array<long>, n array<long>", work, fold)


def _whole(columns: list[np.ndarray]) -> np.ndarray:
    value = columns[0]
    for c in columns[1:]:
        value = _longer(value, c)
    return value


def quicksort_counts(words: np.ndarray, weights: np.ndarray, depths: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(row, length, count) of each phrase that begins suffixes of a weight of ``least`` or more.

    ``words`` has a suffix in each row, 0 behind its end. Pointers to rows are parted into less
    than, equal to and greater than the word of a pivot; the equal part goes on with the next
    word, and parts of less weight are abandoned. Phrases shorter than a row's depth are
    counted elsewhere, since not all their suffixes are here.
    """
    length = words.shape[1]
    stack = [(np.arange(len(words)), 0)]
    while stack:
        rows, at = stack.pop()
        keys = words[rows, at]
        some = np.sort(keys[:: max(1, len(keys) // 32)])
        pivot = some[len(some) // 2]
        equal = rows[keys == pivot]
        if len(equal) < len(rows):
            for part in (rows[keys < pivot], rows[keys > pivot]):
                if len(part) and weights[part].sum() >= least:
                    stack.append((part, at))
        if not pivot:
            continue
        count = int(weights[equal].sum())
        if count < least:
            continue
        if at and at + 1 >= depths[equal[0]]:
            yield int(equal[0]), at + 1, count
        if at + 1 < length:
            stack.append((equal, at + 1))


def _spread_counts(words: np.ndarray, weights: np.ndarray, depths: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, length, count) of phrases shorter than the depth of their rows: shares of their counts."""
    for length in range(2, int(depths.max())):
        rows = np.flatnonzero(depths > length)
        rows = rows[np.lexsort(words[rows, :length].T[::-1])]
        own = words[rows, :length]
        at = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)]))
        yield from zip(rows[at].tolist(), [length] * len(at), np.add.reduceat(weights[rows], at).tolist())


def phrase_counts(suffix_rows: DataFrame, least: int) -> DataFrame:
    """(w1..w5, f) of all phrases of two words or more with ``least`` occurrences; 0 behind their end."""

    def count(table: pa.Table) -> pa.Table:
        words, weights, depths = (pc.list_flatten(table.column(c)).to_numpy() for c in ("words", "n", "depth"))
        words = words.view(np.uint64).reshape(-1, LONGEST)
        found = list(quicksort_counts(words, weights, depths, least))
        if depths.max() > 2:
            found += _spread_counts(words, weights, depths)
        rows, lengths, counts = (np.array(c, np.int64) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        out = np.where(np.arange(LONGEST) < lengths[:, None], words[rows], np.uint64(0)).view(np.int64)
        return pa.table([*[pa.array(out[:, k]) for k in range(LONGEST)], pa.array(counts)], names=[*_WORDS, "f"])

    schema = ", ".join(f"{w} long" for w in _WORDS) + ", f long"
    return suffix_rows.groupBy("group").applyInArrow(count, schema).groupBy(*_WORDS).agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _count_all(docs: DataFrame, least: int, group_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (key, salt, n), totals (salt, total) and frequent phrases (w1..w5, f) of (salt, text)."""
    words = saved(word_counts(docs), "words")
    totals = words.groupBy("salt").agg(F.sum("n").alias("total"))
    frequent = words.where(F.col("n") >= least)
    known = Known(words=bit_array(frequent.select(F.col("key").alias("h"))))
    for length in range(2, LONGEST):
        if length > 3 and not known.common[length - 1].any():
            break
        # Most phrases are rare, and nothing below asks for those.
        leads = saved(lead_counts(docs, known, length).where((F.col("n") >= least) | (F.col("n") > group_rows)), "leads")
        if length < 4:
            known.frequent[length] = bit_array(leads.where(F.col("n") >= least).select("h"))
        if length == 2:
            occurrences = leads.where(F.col("n") >= least).agg(F.sum("n")).first()[0] or 0
        known.common[length] = bit_array(leads.where(F.col("n") > group_rows).select("h"))
        forget(leads)
    groups = occurrences // group_rows + 1
    return frequent, totals, saved(phrase_counts(suffixes(docs, known, groups), least), "phrases")


def _spellings(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, word) of the words of (salt, text) whose key is in the one column of ``keys``."""
    wanted = bit_array(keys.toDF("h").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salts = np.asarray(batch.column(0)).view(np.uint64)
            for first, end, data, rows in chunks(batch.column(1)):
                found, _, words = _places(data, rows, salts[first:end])
                at = np.flatnonzero(passes(wanted, found))
                own, first_at = np.unique(found[at], return_index=True)
                raw = data.tobytes()
                spans = zip(words.starts[at[first_at]].tolist(), words.ends[at[first_at]].tolist())
                texts = [raw[a:b].decode("utf-8", "replace").translate(_LOWER) for a, b in spans]
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(texts, pa.string())], ["key", "word"])

    spelled = docs.mapInArrow(run, "key long, word string").distinct()
    return spelled.join(keys.toDF("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("word").alias("word"))


_LOWER = {c: c + 32 for c in range(65, 91)}


def _best(rows: DataFrame, rank: Callable[[], Column], by: list[Column], top: int) -> DataFrame:
    """Rows of each salt up to place ``top``, first within parts of it, so that no task holds all of one."""
    in_part = W.partitionBy("salt", F.pmod(F.xxhash64("ws"), F.lit(64))).orderBy(*by)
    first = rows.withColumn("rank", rank().over(in_part)).where(F.col("rank") <= top).drop("rank")
    return first.withColumn("rank", rank().over(W.partitionBy("salt").orderBy(*by))).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language in ``docs(text, lang)``.

    Lower-cased pieces between ``.,;:!?`` and line ends are parted into words at blanks and tabs.
    Candidates are phrases of 2 to 5 words that occur ``least`` times or more; the cut of lowest
    score counts, floor(1000 a n / (l r)), and phrases that never occur outside a longer one are
    left out. Ties: higher a, then the phrase in byte order. A null language is ``und``, a null or
    empty text has no words, repeated rows count each time, other columns are ignored, and an
    empty table gives no rows. Texts of any length are read whole.
    """
    named = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    texts = named.select(F.xxhash64("lang").alias("salt"), "text")
    words, totals, phrases = _count_all(texts, least, group_rows)

    packed = F.filter(F.array(*_WORDS), lambda w: w != 0)
    found = saved(phrases.join(words.select(F.col("key").alias("w1"), "salt"), "w1").join(totals, "salt")
                  .select(packed.alias("ws"), F.col("f").alias("a"), "salt", F.col("total").alias("n")), "candidates")
    parts = found.select("ws", F.col("a").alias("f")).union(words.select(F.array("key").alias("ws"), F.col("n").alias("f")))
    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k")).select(
        "ws", "a", "salt", "n", "k", F.expr("slice(ws, 1, k)").alias("first"), F.expr("slice(ws, k + 1, size(ws) - k)").alias("rest")
    )
    scored = cuts.join(parts.toDF("first", "l"), "first").join(parts.toDF("rest", "r"), "rest").select(
        "ws", "a", "salt", "n", "k", "l", "r",
        # Decimals of up to 38 digits hold the products exactly.
        F.expr("(cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))").alias("score"),
    ).groupBy("ws", "a", "salt", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = found.where(F.size("ws") > 2).select(
        F.explode(F.array(F.expr("slice(ws, 1, size(ws) - 1)"), F.expr("slice(ws, 2, size(ws) - 1)"))).alias("ws"), "a"
    )
    own = scored.join(longer.distinct(), ["ws", "a"], "left_anti").select("ws", "a", "salt", "n", "cut.score", "cut.l", "cut.r")
    leading = saved(_best(own, F.rank, [F.col("score").desc(), F.col("a").desc()], top).drop("rank"), "leading")

    placed = leading.select("ws", F.posexplode("ws").alias("place", "key"))
    spelled = _spellings(texts, placed.select("key"))
    phrase = placed.join(spelled, "key").groupBy("ws").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("spelled"))
    ready = leading.join(phrase, "ws").withColumn("phrase", F.array_join(F.transform("spelled", lambda s: s["word"]), " "))
    ranked = _best(ready, F.row_number, [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], top)
    langs = named.select("lang").distinct().select("lang", F.xxhash64("lang").alias("salt"))
    return ranked.join(langs, "salt").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
