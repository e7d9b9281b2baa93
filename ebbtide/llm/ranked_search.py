"""Ranked lexical search by MaxScore with bounds on pairs of terms.

Documents are indexed where they are read, in blocks of some thousand: a block holds the
postings of its documents for the terms that queries ask for, so nothing is shuffled but the
counts of terms. Once these are summed, a second pass writes the index: what every posting
adds to a score, the greatest of each term, and for pairs of terms that stand next to each
other in a query the list of documents with both and the greatest sum there. A query adds up
its lists from the highest weights down; the bound of the terms still to come is that of the
best choice of pairs and single terms, and documents, or whole blocks, that cannot beat the
worst of the best results so far are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.llm.membership import bit_array, passes
from ebbtide.llm.scratch import forget, saved
from ebbtide.llm.words import NO_LETTER, chunks, split_words

TOP = 50
#: Documents, and postings, of a block: whichever is reached first ends it.
BLOCK_DOCS, BLOCK_POSTINGS = 1024, 1 << 17
#: (item, term) rows of the queries that one pass answers; more queries take more passes.
QUERY_TERMS = 1 << 18

POSTINGS = "docs array<long>, lengths array<long>, terms array<long>, sizes array<int>, places array<int>, tfs array<int>"
INDEX = ("docs array<long>, terms array<long>, sizes array<int>, places array<int>, gains array<long>, most array<long>, "
         "pair_sizes array<int>, pair_places array<int>, pair_most array<long>")

_POSTINGS = [part.split()[0] for part in POSTINGS.split(", ")]
_INDEX = [part.split()[0] for part in INDEX.split(", ")]


@dataclass(frozen=True)
class Queries:
    """Terms of some items by falling weight; item k has ``terms[bounds[k]:bounds[k + 1]]``.

    ``pairs`` are the terms next to each other in some item, as indices into ``vocabulary``.
    """

    items: list[int]
    bounds: np.ndarray
    terms: np.ndarray  # index into the vocabulary
    vocabulary: np.ndarray  # sorted hashes
    weights: np.ndarray
    pairs: np.ndarray  # (n, 2)
    pair_of: np.ndarray  # for each place of ``terms`` but the last of an item: the pair it begins


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item; items without an id have no result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, rows in chunks(batch.column(1)):
                words = split_words(data, rows, gaps=NO_LETTER)
                ids = batch.column(0).slice(first, end - first).take(pa.array(np.repeat(np.arange(end - first), np.diff(words.bounds))))
                yield pa.RecordBatch.from_arrays([ids, pa.array(words.hashes.view(np.int64))], ["item_id", "term"])

    asked = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    return asked.mapInArrow(run, "item_id long, term long").distinct()


def _lists(values: list[np.ndarray]) -> list[pa.Array]:
    """Columns of one row, with a list each."""
    return [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in values]


def posting_blocks(docs: DataFrame, wanted: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Blocks of ``docs(doc_id, text)`` with the postings of the terms in ``wanted(term)``.

    A block has less than twice ``block_docs`` documents; those without a term are in none. ``places`` count from the block's first
    document and lie together for each term, ``sizes`` of them.
    """
    table = bit_array(wanted.toDF("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, held, postings, count = [], [], [], 0, 0
        parts = (batch.slice(at, block_docs) for batch in batches for at in range(0, batch.num_rows, block_docs))
        for part in parts:
            for first, end, data, rows in chunks(part.column(1)):
                words = split_words(data, rows, gaps=NO_LETTER)
                sizes = np.diff(words.bounds)
                full = np.flatnonzero(sizes)
                place = np.cumsum(sizes > 0) - 1 + count
                of = np.repeat(place, sizes)
                keep = passes(table, words.hashes)
                held.append((words.hashes[keep], of[keep]))
                ids.append(part.column(0).slice(first, end - first).take(pa.array(full)))
                lengths.append(sizes[full])
                count += len(full)
                postings += int(keep.sum())
                if count >= block_docs or postings >= BLOCK_POSTINGS:
                    yield made(ids, lengths, held)
                    ids, lengths, held, postings, count = [], [], [], 0, 0
        if count:
            yield made(ids, lengths, held)

    def made(ids, lengths, held) -> pa.RecordBatch:
        terms, places = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((places, terms))
        terms, places = terms[order], places[order]
        fresh = np.flatnonzero(np.concatenate([[True], (np.diff(terms) != 0) | (np.diff(places) != 0)])) if len(terms) else np.zeros(0, int)
        tfs = np.diff(np.append(fresh, len(terms)))
        terms, places = terms[fresh], places[fresh]
        at = np.flatnonzero(np.concatenate([[True], np.diff(terms) != 0])) if len(terms) else np.zeros(0, int)
        own = pa.concat_arrays(ids)
        columns = [np.concatenate(lengths), terms[at].view(np.int64), np.diff(np.append(at, len(terms))).astype(np.int32),
                   places.astype(np.int32), tfs.astype(np.int32)]
        first = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
        return pa.RecordBatch.from_arrays([first, *_lists(columns)], _POSTINGS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, POSTINGS)


def term_weights(blocks: DataFrame, total: int) -> DataFrame:
    """(term, weight) of the terms in the blocks: floor(1000 ln((2 N + 2) / (2 df + 1))), N being ``total``."""
    counts = blocks.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(
        F.sum(F.col("t.sizes").cast("long")).alias("df")
    )
    return counts.select("term", F.floor(1000 * F.log((2.0 * total + 2) / (2.0 * F.col("df") + 1))).cast("long").alias("weight"))


def _queries(rows: list) -> Queries:
    """From (item_id, term, weight), by item and falling weight."""
    ids = np.array([r[0] for r in rows], np.int64)
    hashes = np.array([r[1] for r in rows], np.int64).view(np.uint64)
    vocabulary, first, terms = np.unique(hashes, return_index=True, return_inverse=True)
    weights = np.array([r[2] for r in rows], np.int64)[first] if len(rows) else np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(ids) != 0])) if len(ids) else np.zeros(0, int)
    bounds = np.append(starts, len(ids))
    following = np.append(terms[1:], 0) if len(terms) else terms
    both = np.sort(np.column_stack([terms, following]), axis=1)
    pairs, pair_of = np.unique(both, axis=0, return_inverse=True) if len(both) else (both, terms)
    return Queries(ids[starts].tolist(), bounds, terms, vocabulary, weights, pairs, pair_of.ravel())


def _column(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def impact_index(blocks: DataFrame, queries: Queries, total: int, words: int) -> DataFrame:
    """The index of the blocks: gains of all postings, greatest gains of terms, lists and greatest sums of pairs.

    ``terms`` are now indices into the vocabulary, in its order; pairs are in the order of ``queries.pairs``.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                lengths = _column(batch, "lengths", row)
                terms, sizes = _column(batch, "terms", row).view(np.uint64), _column(batch, "sizes", row)
                places, tfs = _column(batch, "places", row), _column(batch, "tfs", row).astype(np.int64)
                norms = 50 + 50 * lengths * total // words
                known = np.searchsorted(queries.vocabulary, terms)
                # What the bit map lets through beside the vocabulary goes here.
                real = queries.vocabulary[np.minimum(known, len(queries.vocabulary) - 1)] == terms
                wanted = np.repeat(real, sizes)
                places, tfs, terms, sizes = places[wanted], tfs[wanted], known[real], sizes[real]
                gains = np.repeat(queries.weights[terms], sizes) * (1_000_000_000 * tfs // (1000 * tfs + 20 * norms[places]))
                offsets = _offsets(sizes)
                most = np.maximum.reduceat(gains, offsets[:-1]) if len(sizes) else np.zeros(0, np.int64)
                slot = np.full(len(queries.vocabulary), -1)
                slot[terms] = np.arange(len(terms))
                dense = np.zeros(len(lengths), np.int64)
                pair_sizes, pair_places, pair_most = np.zeros(len(queries.pairs), np.int32), [], np.zeros(len(queries.pairs), np.int64)
                left = -1
                for k, (a, b) in enumerate(slot[queries.pairs].tolist()):
                    if a < 0 or b < 0 or a == b:
                        continue
                    own = slice(offsets[a], offsets[a + 1])
                    other = slice(offsets[b], offsets[b + 1])
                    if a != left:
                        dense[:] = 0
                        dense[places[own]] = gains[own]
                        left = a
                    met = dense[places[other]]
                    inside = np.flatnonzero(met)
                    if len(inside):
                        pair_sizes[k] = len(inside)
                        pair_places.append(places[other][inside])
                        pair_most[k] = (met[inside] + gains[other][inside]).max()
                joint = np.concatenate(pair_places) if pair_places else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("docs").slice(row, 1), *_lists([terms.astype(np.int64), sizes, places, gains, most, pair_sizes, joint, pair_most])], _INDEX
                )

    return blocks.mapInArrow(run, INDEX)


def tail_bounds(most: np.ndarray, pair_most: np.ndarray) -> np.ndarray:
    """Bounds on what terms k, k + 1, ... add in any one document, for each k, and 0 at the end.

    A term adds at most ``most``, two neighbours together at most ``pair_most`` (at place k for
    terms k and k + 1); the least bound over all choices of neighbours is taken.
    """
    bounds = np.zeros(len(most) + 2, np.int64)
    for k in range(len(most) - 1, -1, -1):
        bounds[k] = bounds[k + 1] + most[k]
        if k + 1 < len(most):
            bounds[k] = min(bounds[k], bounds[k + 2] + pair_most[k])
    return bounds[:-1]


class Block:
    """One block of the index, ready to be asked."""

    def __init__(self, batch: pa.RecordBatch, row: int, queries: Queries) -> None:
        self.size = len(batch.column("docs")[row])
        self.gains, self.places = _column(batch, "gains", row), _column(batch, "places", row)
        self.offsets = _offsets(_column(batch, "sizes", row))
        terms = _column(batch, "terms", row)
        self.slot = np.full(len(queries.vocabulary), -1)
        self.slot[terms] = np.arange(len(terms))
        self.most = np.zeros(len(queries.vocabulary), np.int64)
        self.most[terms] = _column(batch, "most", row)
        self.pair_most = _column(batch, "pair_most", row)
        self.pair_offsets = _offsets(_column(batch, "pair_sizes", row))
        self.pair_places = _column(batch, "pair_places", row)
        self.dense = np.zeros(self.size, np.int64)
        # A pair is bounded by its joint greatest sum, and by each term alone where the other is missing.
        alone = np.maximum(self.most[queries.pairs[:, 0]], self.most[queries.pairs[:, 1]])
        self.pair_bound = np.maximum(self.pair_most, alone)

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        k = self.slot[term]
        if k < 0:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        own = slice(self.offsets[k], self.offsets[k + 1])
        return self.places[own], self.gains[own]

    def best(self, queries: Queries, item: int, worst: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, score) of documents that may be among the ``top`` with a score of ``worst`` or more."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = queries.bounds[item : item + 2]
        terms, pair_of = queries.terms[low:high], queries.pair_of[low : high - 1]
        bounds = tail_bounds(self.most[terms], self.pair_bound[pair_of])
        if bounds[0] < max(worst, 1):
            return none
        scores = self.dense
        scores[:] = 0
        if worst <= 1:
            worst = self.first_guess(terms, pair_of, top)
        k = 0
        # Essential terms: those before any tail that could by itself still reach the worst score.
        while k < len(terms) and bounds[k] >= max(worst, 1):
            places, gains = self.postings(terms[k])
            scores[places] += gains
            k += 1
        found = np.flatnonzero(scores)
        while k < len(terms) and len(found):
            found = found[scores[found] + bounds[k] >= worst]
            places, gains = self.postings(terms[k])
            # The shorter side looks itself up in the longer.
            if len(places) <= 8 * len(found):
                scores[places] += gains
            else:
                at = np.minimum(np.searchsorted(places, found), len(places) - 1)
                scores[found] += np.where(places[at] == found, gains[at], 0)
            k += 1
        found = found[scores[found] >= max(worst, 1)]
        return found, scores[found]

    def first_guess(self, terms: np.ndarray, pair_of: np.ndarray, top: int) -> int:
        """A score that ``top`` documents of the block surely reach: sums over one pair's list, or 0."""
        best = 0
        for k, pair in enumerate(pair_of.tolist()):
            own = self.pair_places[self.pair_offsets[pair] : self.pair_offsets[pair + 1]]
            if len(own) < top or self.pair_bound[pair] <= best:
                continue
            sums = np.zeros(len(own), np.int64)
            for term in (terms[k], terms[k + 1]):
                places, gains = self.postings(term)
                sums += gains[np.searchsorted(places, own)]
            best = max(best, int(np.partition(sums, len(sums) - top)[len(sums) - top]))
        return best


def search_blocks(index: DataFrame, queries: Queries, top: int) -> DataFrame:
    """(item_id, doc_id, score): for each task and item the ``top`` documents of its blocks, and ties of the last.

    The worst score of a full list is carried from block to block.
    """
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * len(queries.items)
        worst = [0] * len(queries.items)
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row, queries)
                docs = batch.column("docs")[row].values
                ids, missing = docs.fill_null(0).to_numpy(), docs.is_null().to_numpy(zero_copy_only=False)
                for item in range(len(queries.items)):
                    found, scores = block.best(queries, item, worst[item], top)
                    if not len(found):
                        continue
                    old = held[item]
                    ids_now = np.concatenate([old[0], ids[found]])
                    scores_now = np.concatenate([old[1], scores])
                    missing_now = np.concatenate([old[2], missing[found]])
                    order = np.lexsort((ids_now, missing_now, -scores_now))[:top]
                    held[item] = ids_now[order], scores_now[order], missing_now[order]
                    if len(order) == top:
                        worst[item] = int(held[item][1][-1])
        for item, (ids, scores, missing) in zip(queries.items, held):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array(ids, mask=missing), pa.array(scores)], ["item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item_id long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, query_terms: int = QUERY_TERMS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of ``docs(doc_id, text)`` for each of ``items(item_id, text)``.

    Terms are runs of letters, digits and characters outside ASCII, A-Z lower-cased. Only scores
    above 0 count; ties go to the smaller doc_id, those without one last. A null or empty text
    has no terms. Each row of ``docs`` is a document, so repeated rows are ranked each; rows of
    one item_id are one item with the terms of all; items without an id are left out. Other
    columns are ignored; an empty table on either side gives no rows. Texts of any length are
    read whole. ``query_terms`` bounds what is sent to the tasks: the queries are answered in
    as many groups of items as that takes, an item of more terms alone.
    """
    spark = docs.sparkSession
    asked = saved(item_terms(items), "item-terms")
    blocks = saved(posting_blocks(docs, asked.select("term").distinct(), block_docs), "postings")
    total, words = blocks.agg(F.sum(F.size("docs").cast("long")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x))).first()
    results = spark.createDataFrame([], "item_id long, doc_id long, score long")
    if total:
        weighted = saved(asked.join(term_weights(blocks, total), "term"), "weighted")
        for group in _groups(weighted, query_terms):
            rows = weighted.join(group, "item_id", "left_semi") if group is not None else weighted
            queries = _queries(rows.select("item_id", "term", "weight").orderBy("item_id", F.col("weight").desc(), "term").collect())
            if queries.items:
                index = saved(impact_index(blocks, queries, total, words), "impacts")
                results = results.union(saved(search_blocks(index, queries, top), "found"))
                forget(index)
    forget(blocks)
    by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    return results.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*by))).where(F.col("rank") <= top).select(
        "item_id", "rank", "doc_id", "score"
    )


def _groups(weighted: DataFrame, most: int) -> Iterator[DataFrame | None]:
    """Sets of items with about ``most`` terms together; None for all at once."""
    total = weighted.count()
    if total <= most:
        yield None
        return
    parts = -(-total // most)
    sizes = weighted.groupBy("item_id").count()
    dealt = saved(sizes.select("item_id", F.pmod(F.xxhash64("item_id"), F.lit(parts)).alias("part")), "dealt")
    for part in range(parts):
        yield dealt.where(F.col("part") == part).select("item_id")
