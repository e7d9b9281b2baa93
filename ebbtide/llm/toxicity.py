"""Toxicity of whole texts by a logistic model that is indifferent to group mentions.

Features say which words, and which beginnings of words, a text holds; they are exact 64-bit
hashes, not buckets. Features are chosen by their association with the label among the
labelled rows of a bounded sample. For sampled texts that mention an identity term, copies
with the term swapped for other terms are made, and the fit penalises every change of score
between a text and its copies, so that a group's name alone does not make a text toxic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.membership import bit_array, only_members, passes
from ebbtide.llm.scratch import saved
from ebbtide.llm.words import NO_LETTER, chunks, mix, prefix_hashes, split_words

#: Labelled rows that the model is fitted on, at most about.
SAMPLE_ROWS = 24_000
#: Features of the model, at most.
FEATURES = 4096
#: Beginnings of words that count as features, in bytes.
PREFIXES = (4, 5, 6, 7, 8)
#: Toxic texts of the sample that a feature must be in.
SUPPORT = 5
#: Score change between swapped copies is weighted like this many labels.
PENALTY = 10.0
THRESHOLD = 0.3

#: Default identity terms: fixed values.
IDENTITY_TERMS = (
    "asian", "black", "buddhist", "catholic", "christian", "disabled", "female", "gay", "hispanic", "immigrant",
    "jewish", "latino", "lesbian", "male", "muslim", "refugee", "straight", "transgender", "white", "woman",
)


def feature_rows(column: pa.Array, keep: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """By chunk: first row, end row, row of each feature found and its hash; distinct within a row.

    ``keep``: a bit map that features must pass.
    """
    for first, end, data, rows in chunks(column):
        words = split_words(data, rows, gaps=NO_LETTER)
        owner = np.repeat(np.arange(len(rows) - 1), np.diff(words.bounds))
        parts = [(owner, words.hashes)]
        parts += [(owner[longer], made) for longer, made in (prefix_hashes(words, n) for n in PREFIXES)]
        if keep is not None:
            parts = [(o[p], h[p]) for o, h in parts for p in (passes(keep, h),)]
        row, found = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.lexsort((found, row))
        row, found = row[order], found[order]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
        yield first, end, row[fresh], found[fresh]


def _feature_lists(rows: DataFrame, text: str, keep: np.ndarray | None = None) -> DataFrame:
    """``rows`` with the column ``text`` replaced by the array of its features."""
    others = [c for c in rows.columns if c != text]
    shared = rows.sparkSession.sparkContext.broadcast(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, row, found in feature_rows(batch.column(0), shared.value):
                bounds = np.searchsorted(row, np.arange(end - first + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(found.view(np.int64)))
                own = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([lists, *(own.column(k + 1) for k in range(len(others)))], [text, *others])

    schema = ", ".join([f"{text} array<long>", *(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*others).schema)])
    return rows.select(text, *others).mapInArrow(run, schema)


def swapped(text: str, terms: Sequence[str]) -> list[str]:
    """Copies of a text in which every identity term is moved on by one, and by half the list."""
    found = re.compile(r"\b(" + "|".join(map(re.escape, terms)) + r")\b", re.IGNORECASE)
    if not terms or not found.search(text):
        return []
    place = {t: k for k, t in enumerate(terms)}
    steps = sorted({1, len(terms) // 2} - {0, len(terms)})
    return [found.sub(lambda m, by=by: terms[(place[m[0].lower()] + by) % len(terms)], text) for by in steps]


def _copies(rows: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(row, toxic, copy, text): each text as copy 0, then its swapped copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, toxic, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                out += [(row, toxic, k, t) for k, t in enumerate([text or "", *swapped(text or "", terms)])]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["row", "toxic", "copy", "text"])

    return rows.select("row", "toxic", "text").mapInArrow(run, "row long, toxic int, copy int, text string")


class Model(NamedTuple):
    features: np.ndarray  # sorted 64-bit hashes
    weights: np.ndarray
    intercept: float


def fit_toxicity(labelled: DataFrame, terms: Sequence[str] = IDENTITY_TERMS, penalty: float = PENALTY, ridge: float = 1.0) -> Model:
    """The model of a bounded table ``labelled(text, toxic)``. No rows, or one label only: no features."""
    rows = saved(_copies(labelled.withColumn("row", F.monotonically_increasing_id()), terms), "labelled")
    plain = rows.where("copy = 0")
    count, toxic = plain.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    rate = (toxic + 0.5) / (count + 1)
    start = float(np.log(rate / (1 - rate)))
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), start)
    if not toxic or toxic == count:
        return nothing
    common = (
        _feature_lists(plain.where("toxic = 1").select("text"), "text").select(F.explode("text").alias("h"))
        .groupBy("h").count().where(F.col("count") >= SUPPORT).select("h")
    )
    listed = saved(_feature_lists(rows, "text", bit_array(common)), "features")
    # Twice the log likelihood ratio between "depends on the label" and "does not".
    by = listed.where("copy = 0").select("toxic", F.explode("text").alias("h")).groupBy("h").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("k")
    ).where(F.col("k") >= SUPPORT)
    term = "CASE WHEN {0} > 0 THEN {0} * ln({0} / {1}) ELSE 0 END"
    cells = [("k", f"(n * {toxic} / {count})"), ("(n - k)", f"(n * {count - toxic} / {count})"),
             (f"({toxic} - k)", f"(({count} - n) * {toxic} / {count})"), (f"({count - toxic} - n + k)", f"(({count} - n) * {count - toxic} / {count})")]
    gain = " + ".join(term.format(seen, f"greatest({expected}, 1e-9)") for seen, expected in cells)
    chosen = by.withColumn("gain", F.expr(gain)).where("gain > 15").orderBy(F.desc("gain"), "h").limit(FEATURES)
    features = np.sort(np.array([r[0] for r in chosen.select("h").collect()], np.int64).view(np.uint64))
    if not len(features):
        return nothing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [np.flatnonzero(np.isin(features, np.array(x, np.int64).view(np.uint64), assume_unique=True)) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.list_(pa.int32())), *(batch.column(k) for k in (1, 2, 3))], ["slots", "row", "toxic", "copy"])

    design = listed.select("text", "row", "toxic", "copy").mapInArrow(run, "slots array<int>, row long, toxic int, copy int").toArrow()
    return _fit(features, design.sort_by([("row", "ascending"), ("copy", "ascending")]), start, penalty, ridge)


def _fit(features: np.ndarray, design: pa.Table, start: float, penalty: float, ridge: float, steps: int = 400) -> Model:
    """Minimise log loss + penalty * (change of logit between copies)^2 / 2 + ridge * |w|^2 / 2, by Adam."""
    lists = design["slots"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    slot = pc.list_flatten(lists).to_numpy()
    sizes = pc.list_value_length(lists).to_numpy()
    copy, label, row = (design[c].to_numpy() for c in ("copy", "toxic", "row"))
    item = np.repeat(np.arange(len(sizes)), sizes)
    plain = copy == 0
    origin = np.flatnonzero(plain)[np.cumsum(plain) - 1]
    weights, intercept = np.zeros(len(features) + 1), start
    weights[-1] = intercept
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        logit = np.bincount(item, weights=weights[slot], minlength=len(sizes)) + weights[-1]
        p = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        pull = np.where(plain, p - label, 0.0)
        change = penalty * (logit - logit[origin])
        np.add.at(pull, origin, -change)
        pull += change
        grad = np.bincount(slot, weights=pull[item], minlength=len(weights)).astype(float)
        grad[-1] = pull.sum()
        grad[:-1] += ridge * weights[:-1]
        grad /= max(1, plain.sum())
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        weights -= 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Model(features, weights[:-1].copy(), float(weights[-1]))


def predict_toxicity(texts: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of (doc_id, text)."""
    mixed = model.features
    table = np.zeros(1 << 18, np.uint64)
    np.bitwise_or.at(table, (mixed >> np.uint64(46)).astype(np.int64), np.uint64(1) << (mixed & np.uint64(63)))
    shared = texts.sparkSession.sparkContext.broadcast((model, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (features, weights, intercept), keep = shared.value
        for batch in batches:
            scores = np.full(batch.num_rows, intercept)
            for first, end, row, found in feature_rows(batch.column(1), keep):
                if len(features):
                    at = np.minimum(np.searchsorted(features, found), len(features) - 1)
                    value = np.where(features[at] == found, weights[at], 0.0)
                    scores[first:end] += np.bincount(row, weights=value, minlength=end - first)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(scores, -40, 40))))], ["doc_id", "score"])

    return texts.mapInArrow(run, "doc_id long, score double")


#: Hash values that a sample is drawn from: the share of any table has a limit among them that is not 0.
_DRAWS = 1 << 60


def _draw_limit(sample_rows: int, rows: int) -> int:
    """Rows whose draw is below this are about ``sample_rows`` of ``rows``, or all of fewer."""
    return min(_DRAWS, _DRAWS * sample_rows // max(1, rows))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, sample_rows: int = SAMPLE_ROWS, terms: Sequence[str] = IDENTITY_TERMS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs(doc_id, text)``.

    Learns from ``labels(doc_id, toxic)`` of documents whose crc32 of doc_id, modulo ``folds``,
    is not ``held``; of more than ``sample_rows`` such labels a share drawn by hash. Of labels
    that repeat a doc_id the largest counts; null labels, and labels without a document, do not.
    Null and empty texts get the score of a text without features. Other columns are ignored;
    an empty table gives no rows.
    """
    in_fold = F.crc32(F.col("doc_id").cast("string")) % folds != held
    marks = saved(
        labels.where(in_fold & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")),
        "marks",
    )
    drawn = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(_DRAWS)) < _draw_limit(sample_rows, marks.count()))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labelled = only_members(texts, "doc_id", drawn.select("doc_id")).dropDuplicates(["doc_id"]).join(drawn, "doc_id")
    return predict_toxicity(texts, fit_toxicity(labelled.select("text", "toxic"), terms)).select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % folds == held).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
