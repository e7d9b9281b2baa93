"""Documents packed into sequences of bounded length, with a certificate by lower bounds.

Tokenised pieces are dealt by hash into groups of bounded size, and each group is packed by
best-fit decreasing. Dual-feasible functions turn a group's lengths into a lower bound on its
bins: a group that meets it is as good as it can be alone. While the total exceeds the bound of
all lengths, groups with a gap give up their open bins, and all groups those with the most free
space, until it makes up twice the excess. Their documents are dealt anew, to groups twice as
large, and packed again. Rounds end when the total meets the bound of all lengths or when
``patience`` deals in a row save no bin.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.scratch import forget, saved, saved_in_batches
from ebbtide.llm.tokens import WordTokenizer, tokenizer_path
from ebbtide.llm.words import chunks

CAPACITY = 2048
#: Pieces that one task packs at a time, on average; at each new deal twice as many, up to GROWTH times.
GROUP_PIECES, GROWTH = 40_000, 16


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of (doc_id, text): every text's ids, then id 0, in runs of ``capacity``."""
    path = path or tokenizer_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordTokenizer.of(path)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = []
            for a, b, data, rows in chunks(batch.column(1)):
                made = encoder.encode(data, rows)
                tokens = made.ids.astype("<u4")
                for r in range(b - a):
                    own = np.append(tokens[made.bounds[r] : made.bounds[r + 1]], np.uint32(0)).astype("<u4")
                    for piece, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        out.append((ids[a + r], piece, at, len(part), zlib.crc32(part.tobytes())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the free space of each bin.

    Items go from long to short into the fullest bin that still takes them. Bins are kept by
    free space, and a bit mask of the occurring free spaces finds the smallest sufficient one.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[int] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_free[room].pop()
            if not by_free[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        bins[k], offsets[k] = b, capacity - room
        left = room - size
        free[b] = left
        if left:
            by_free[left].append(b)
            mask |= 1 << left
    return bins, offsets, np.array(free, np.int64)


def dual_bound(histogram: np.ndarray, capacity: int) -> int:
    """A lower bound on the bins of items by length (``histogram[length]``), from dual-feasible functions.

    Each function maps lengths so that no full bin maps to more than one unit; the mapped
    sum, rounded up, bounds the bins from below. Two families are used: one lifts lengths
    above capacity - e to a whole bin and drops those below e, for every e up to half; the
    other rounds multiples of capacity / (k + 1) down in steps of 1 / k.
    """
    size = np.arange(capacity + 1)
    counts = histogram[: capacity + 1].astype(np.int64)
    best = -(-int((counts * size).sum()) // capacity)
    sums, whole = np.cumsum(counts * size), np.cumsum(counts)
    for e in range(1, capacity // 2 + 1):
        middle = sums[capacity - e] - sums[e - 1]
        best = max(best, -(-int(middle) // capacity) + int(whole[capacity] - whole[capacity - e]))
    for k in range(1, 50):
        exact = size * (k + 1) % capacity == 0
        # In units of 1 / (k * capacity) of a bin.
        mapped = np.where(exact, size * k, size * (k + 1) // capacity * capacity)
        best = max(best, -(-int((counts * mapped).sum()) // (k * capacity)))
    return best


_PIECE = ["rid", "doc_id", "piece", "start", "length", "ids_crc32"]
_PACKED = (
    "rid long, doc_id long, piece int, start long, length long, ids_crc32 long, round int, dealt long, bin long, offset long, open long, gap long"
)


def _pack_groups(pieces: DataFrame, groups: int, turn: int, capacity: int) -> DataFrame:
    """Pieces with bin, offset, free space of the bin, and the group's bins beyond its bound."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("rid").combine_chunks()
        lengths = group["length"].to_numpy()
        bins, offsets, free = best_fit_decreasing(lengths, capacity)
        gap = len(free) - dual_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        columns = [group[name] for name in _PIECE] + [
            pa.array(np.full(len(lengths), turn, np.int32)), group["dealt"], pa.array(bins), pa.array(offsets),
            pa.array(free[bins]), pa.array(np.full(len(lengths), gap, np.int64)),
        ]
        return pa.table(columns, [part.split()[0] for part in _PACKED.split(", ")])

    dealt = F.pmod(F.xxhash64("rid", F.lit(turn)), F.lit(groups))
    return pieces.withColumn("dealt", dealt).groupBy("dealt").applyInArrow(pack, _PACKED)


def _least_open(packed: DataFrame, excess: int, capacity: int) -> int:
    """Bins with this free space or more hold twice ``excess`` bins of it together, or all there is."""
    wanted = 2 * excess * capacity
    for size, bins in sorted(packed.where("offset = 0 AND open > 0").groupBy("open").count().collect(), reverse=True):
        wanted -= size * bins
        if wanted <= 0:
            return size
    return 1


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, patience: int = 3) -> DataFrame:
    """``pieces`` (saved, with a unique ``rid``) with sequence_id, offset and bound.

    ``bound`` is the lower bound on the sequences of all pieces together. Only sums and the
    histogram of lengths, of capacity + 1 rows, reach the driver.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    bound, rest = dual_bound(counts, capacity), pieces
    total = int(counts.sum())
    done: list[DataFrame] = []
    settled, turn, failed = 0, 0, 0
    loose, loose_bins = None, None
    while True:
        groups = max(1, -(-total // (group_pieces * min(1 << turn, GROWTH))))
        packed = saved(_pack_groups(rest, groups, turn, capacity), "packed")
        used = packed.where("offset = 0").count()
        turn += 1
        if loose is not None and used >= loose_bins:
            # Nothing saved: these documents stay where they were, unless another deal helps.
            forget(packed)
            failed += 1
            if failed == patience or groups == 1:
                done.append(loose)
                break
            continue
        if loose is not None:
            forget(loose)
        released = f"(gap > 0 AND open > 0) OR open >= {_least_open(packed, settled + used - bound, capacity)}"
        open_bins = packed.where("offset = 0").where(released).count()
        if settled + used <= bound or open_bins < 2:
            done.append(packed)
            break
        loose, loose_bins, failed = saved(packed.where(released), "loose"), open_bins, 0
        done.append(saved(packed.where(f"NOT ({released})"), "kept"))
        forget(packed)
        settled += used - open_bins
        rest = loose.select(*_PIECE)
        total = rest.count()
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out.withColumn("bound", F.lit(bound).cast("long"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, bound.

    Null and empty texts are the one id 0. Only documents longer than ``capacity`` are cut.
    Repeated rows are packed each for itself; rows without doc_id too. Other columns are
    ignored. An empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = saved_in_batches(token_pieces(texts, capacity, path).withColumn("rid", F.monotonically_increasing_id()), "pieces")
    packed = pack_pieces(pieces, capacity, group_pieces)
    # Round, group and bin in one number: 10, 27 and 26 bits.
    number = F.shiftleft(F.col("round").cast("long"), 53) + F.shiftleft("dealt", 26) + F.col("bin")
    return packed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset", "bound"
    )
