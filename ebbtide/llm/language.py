"""Language of a text: multinomial naive Bayes over hashed character n-grams.

Runs of one to three letters (anything else counts as one blank) are hashed to a fixed number
of buckets. Tasks count buckets by language, Spark sums the counts, and the matrix of log
probabilities, whose size is languages x buckets and is checked, is broadcast for scoring.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.words import chunks

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
#: The broadcast matrix may have this many bytes; more languages than fit raise an error.
MATRIX_LIMIT = 64 << 20
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Lower-case code point of each letter, a blank for everything else."""
    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        if (s := chr(c)).isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(data: np.ndarray, rows: np.ndarray, buckets: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each code point by order, bounds of the rows, letters by row.

    N-grams that would cross the end of a row get bucket ``buckets``.
    """
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    at = lead[rows]
    letters = _letters()[points]
    known = np.concatenate([[0], np.cumsum(letters != 32)])
    out, code = [], np.zeros(len(letters), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        reach = max(0, len(letters) - order + 1)
        code = code[:reach] * np.uint64(0x9E3779B97F4A7C15) + letters[order - 1 :].astype(np.uint64) + np.uint64(order)
        if order not in ORDERS:
            continue
        slot = np.full(len(letters), buckets, np.int32)
        slot[:reach] = ((code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - buckets.bit_length() + 1)
        for back in range(1, order):
            over = at[1:] - back
            slot[over[over >= at[:-1]]] = buckets
        out.append(slot)
    return out, at, known[at[1:]] - known[at[:-1]]


def bucket_counts(labelled: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(label, bucket, n) of (text, label): n-grams by label, summed over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            for a, b, data, rows in chunks(batch.column(0)):
                slots, at, letters = grams(data, rows, buckets)
                labels, which = np.unique(names[a:b].astype(str), return_inverse=True)
                for k, label in enumerate(labels):
                    mine = (which == k) & (letters > 0)
                    if not mine.any():
                        continue
                    own = np.repeat(mine, np.diff(at))
                    total = sums.setdefault(str(label), np.zeros(buckets + 1, np.int64))
                    for slot in slots:
                        total += np.bincount(slot[own], minlength=buckets + 1)
                    seen[str(label)] = seen.get(str(label), 0) + int(mine.sum())
        for label, total in sums.items():
            total[buckets] = seen[label]
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(found)), pa.array(found), pa.array(total[found])], ["label", "bucket", "n"]
            )

    return labelled.mapInArrow(run, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))


def fit_languages(labelled: DataFrame, buckets: int = BUCKETS, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages in order of name and their log probabilities by bucket (the last row: none, 0), then log priors.

    All rows of ``labelled(text, label)`` with a letter count. No such row: no languages.
    """
    counts = bucket_counts(labelled, buckets)
    limit = MATRIX_LIMIT // (4 * (buckets + 2))
    names = sorted(r[0] for r in counts.select("label").distinct().limit(limit + 1).collect())
    if len(names) > limit:
        raise ValueError(f"more than {limit} languages")
    table = np.zeros((buckets + 2, len(names)))
    place = {name: k for k, name in enumerate(names)}
    for label, bucket, n in counts.collect():
        table[bucket, place[label]] = n
    if names:
        docs = table[buckets].copy()
        grams_of = table[:buckets] + smoothing
        table[:buckets] = np.log(grams_of / grams_of.sum(axis=0))
        table[buckets] = 0
        table[buckets + 1] = np.log(docs / docs.sum())
    return names, table.astype(np.float32)


def predict_languages(docs: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score) of (doc_id, text); score: the posterior of the prediction.

    Null texts, texts without a letter, and all texts if nothing was learned: ``und``, 0.
    Ties go to the first name.
    """
    buckets = len(table) - 2
    model = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value
        for batch in batches:
            picks, scores = [], []
            for _, _, data, rows in chunks(batch.column(1)):
                slots, at, letters = grams(data, rows, buckets)
                total = np.zeros((len(letters), len(names)))
                full = np.flatnonzero(np.diff(at))
                if len(full) and names:
                    for k in range(len(names)):
                        own = np.ascontiguousarray(weights[:, k])
                        each = own[slots[0]]
                        for slot in slots[1:]:
                            each += own[slot]
                        total[full, k] = np.add.reduceat(each, at[full], dtype=np.float64)
                    total += weights[buckets + 1]
                    best = total.argmax(axis=1)
                    share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                for r, n in enumerate(letters):
                    known = bool(n and names)
                    picks.append(names[best[r]] if known else UNKNOWN)
                    scores.append(float(share[r]) if known else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(picks, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify_languages(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of ``docs(doc_id, text, lang)``, one row per row.

    Learns from the rows with a language whose crc32 of doc_id, modulo ``folds``, is not
    ``held``; predictions read the text alone. Rows without doc_id count as held out by null
    and are not learned from. Other columns are ignored; an empty table gives no rows.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % folds == held
    names, table = fit_languages(docs.where(~fold & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").alias("label")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return predict_languages(texts, names, table).select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % folds == held).alias("held_out"), "lang_pred", "score"
    )
