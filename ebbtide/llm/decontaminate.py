"""Documents that hold passages of a benchmark, also in another order, by greedy string tiling.

Seeds are runs of ``seed`` words (letters and digits, lower-cased). A broadcast bit map of
fixed size over the benchmark's seeds picks the documents that may share some, an exact join
finds the (document, item) pairs, and pairs with too few shared seeds to reach the coverage
are dropped. Each pair left is tiled: the longest match of words not yet covered is marked
until none has ``seed`` words, and the covered share of the item decides.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.membership import bit_array, passes
from ebbtide.llm.scratch import saved, saved_in_batches
from ebbtide.llm.words import NO_LETTER, chunks, shingle_hashes, split_words

SEED, COVERAGE = 5, 0.5


def greedy_tiles(item: np.ndarray, doc: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, length) of greedy string tiles of at least ``seed`` words.

    Karp-Rabin fingerprints of ``seed`` words find where both agree. Diagonal runs of such
    places are the maximal matches; the longest is marked first (ties: first in the item, then
    in the document), and what earlier tiles leave of a later match goes back to the queue.
    """
    if len(item) < seed or len(doc) < seed:
        return []
    prints_item, prints_doc = _prints(item, seed), _prints(doc, seed)
    order = np.argsort(prints_item, kind="stable")
    low = np.searchsorted(prints_item[order], prints_doc, "left")
    high = np.searchsorted(prints_item[order], prints_doc, "right")
    hits = high - low
    j = np.repeat(np.arange(len(prints_doc)), hits)
    i = order[np.repeat(low - (np.cumsum(hits) - hits), hits) + np.arange(hits.sum())]
    runs = np.lexsort((i, j - i))
    i, j = i[runs], j[runs]
    if not len(i):
        return []
    fresh = np.flatnonzero(np.concatenate([[True], (np.diff(j - i) != 0) | (np.diff(i) != 1)]))
    lengths = np.diff(np.append(fresh, len(i))) + seed - 1
    queue = [(-int(n), int(i[k]), int(j[k])) for k, n in zip(fresh, lengths)]
    heapq.heapify(queue)
    used_item, used_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    tiles = []
    while queue:
        n, a, b = heapq.heappop(queue)
        free = ~(used_item[a : a - n] | used_doc[b : b - n])
        if free.all():
            used_item[a : a - n] = used_doc[b : b - n] = True
            tiles.append((a, b, -n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s >= seed:
                heapq.heappush(queue, (s - e, a + s, b + s))
    return tiles


def _prints(words: np.ndarray, seed: int) -> np.ndarray:
    total = len(words) - seed + 1
    value = np.zeros(total, np.uint64)
    for k in range(seed):
        value = value * np.uint64(0x9E3779B97F4A7C15) + words[k : total + k]
    return value


def _seed_rows(items: DataFrame, seed: int) -> DataFrame:
    """(item_id, words, seeds) of (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            words_of, seeds_of = [], []
            for _, _, data, rows in chunks(batch.column(1)):
                words = split_words(data, rows, gaps=NO_LETTER)
                seeds, at = shingle_hashes(words, seed)
                for r in range(len(rows) - 1):
                    words_of.append(words.hashes[words.bounds[r] : words.bounds[r + 1]].view(np.int64))
                    seeds_of.append(seeds[at[r] : at[r + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words_of, kind), pa.array(seeds_of, kind)], ["item_id", "words", "seeds"]
            )

    return items.mapInArrow(run, "item_id long, words array<long>, seeds array<long>")


def _documents_with_seeds(docs: DataFrame, table: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, words, seeds) of the documents with a seed that passes the map."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: tuple[list, list, list] = ([], [], [])
            for first, _, data, rows in chunks(batch.column(1)):
                words = split_words(data, rows, gaps=NO_LETTER)
                seeds, at = shingle_hashes(words, seed)
                hit = np.flatnonzero(passes(shared.value, seeds))
                owner = np.searchsorted(at, hit, "right") - 1
                for r in np.unique(owner):
                    if ids[first + r] is None:
                        continue
                    out[0].append(ids[first + r])
                    out[1].append(words.hashes[words.bounds[r] : words.bounds[r + 1]].view(np.int64))
                    out[2].append(np.unique(seeds[hit[owner == r]]).view(np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], kind), pa.array(out[2], kind)], ["doc_id", "words", "seeds"]
                )

    return docs.mapInArrow(run, "doc_id long, words array<long>, seeds array<long>")


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, tiles, coverage) of each pair that reaches ``coverage``.

    ``docs(doc_id, text)``, ``benchmark(item_id, text)``. Rows without an id, null and empty
    texts, and items or documents with fewer than ``seed`` words are in no pair. Repeated rows
    give one pair; if rows of one doc_id differ, the best counts. Other columns are ignored.
    Empty tables give no rows.
    """
    items = saved(
        _seed_rows(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null"), seed)
        .where(F.size("seeds") > 0), "items",
    )
    seeds = items.select("item_id", F.posexplode("seeds").alias("place", "seed"))
    table = bit_array(seeds.select(F.col("seed").alias("h")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = saved_in_batches(_documents_with_seeds(texts, table, seed).withColumn("row", F.monotonically_increasing_id()), "found")
    # A tile of n words holds n - seed + 1 seeds, so least seeds per covered word is one in ``seed``.
    need = F.ceil(F.lit(coverage) * F.col("item_words") / seed)
    sizes = items.select("item_id", F.size("words").alias("item_words"))
    pairs = (
        found.select("row", F.explode("seeds").alias("seed")).join(seeds, "seed")
        .groupBy("row", "item_id").agg(F.count("*").alias("shared"))
        .join(sizes, "item_id").where(F.col("shared") >= need).select("row", "item_id")
    )
    tiled = (
        pairs.join(items.select("item_id", F.col("words").alias("item")), "item_id")
        .join(found.select("row", "doc_id", F.col("words").alias("doc")), "row")
        .select("doc_id", "item_id", "item", "doc")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "item_id", "item_words", "covered_words", "tiles"]
        for batch in batches:
            sizes, covered, tiles = [], [], []
            for item, doc in zip(_arrays(batch.column(2)), _arrays(batch.column(3))):
                made = greedy_tiles(item, doc, seed)
                sizes.append(len(item))
                covered.append(sum(t[2] for t in made))
                tiles.append(len(made))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (sizes, covered, tiles))], names
            )

    scored = tiled.mapInArrow(run, "doc_id long, item_id long, item_words long, covered_words long, tiles long")
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("covered_words", "item_words", F.negative("tiles").alias("t"))).alias("best"))
    return best.select(
        "doc_id", "item_id", "best.item_words", "best.covered_words", F.negative("best.t").alias("tiles"),
        (F.col("best.covered_words") / F.col("best.item_words")).alias("coverage"),
    ).where(F.col("coverage") >= coverage)


def _arrays(column: pa.ListArray) -> Iterator[np.ndarray]:
    flat, at = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    for a, b in zip(at[:-1], at[1:]):
        yield flat[a:b]
