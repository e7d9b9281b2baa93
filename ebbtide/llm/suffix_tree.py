"""Log probabilities of texts by a probabilistic suffix tree, beside a word-count base.

A text is its lower-cased words, each closed by a blank, and one end sign: a sequence of
bytes that stands for the word sequence one to one. The tree's states are byte contexts of up
to ``DEPTH`` bytes. A context is a state if it was seen ``LEAST`` times, whatever the size of
the table, and if its next-byte distribution diverges enough from that of the context one byte
shorter: the log likelihood gained on its own counts must pay for its free parameters. A
state's distribution is smoothed towards the next shorter state, down to the single bytes; a
place is scored by its longest state.

States and word counts grow with the table, so neither is ever broadcast. Documents are put in
blocks, a block asks for its distinct words and its distinct contexts with next byte once, the
counts are summed and the probabilities made in Spark, and the answers go back by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ebbtide.llm.scratch import forget, saved
from ebbtide.llm.words import Words, chunks, mix, split_words

DEPTH = 6
#: Occurrences that make a context a state, if it also diverges.
LEAST = 2
#: A gain that pays for the parameters exactly is not enough, whatever the order of its sum.
_EVEN = 1e-9
#: Weight of the shorter state against counts.
WEIGHT = 8.0
#: Bytes of text in a block of documents that ask for word counts together.
BLOCK_BYTES = 6 << 20
#: Bytes of text for each group of codes, of which about a tenth are distinct.
GROUP_BYTES = 16 << 20

_END = 10
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PIECE = 2 << 20


def canonical(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows (words closed by blanks, then the end sign) and their bounds."""
    sizes = words.ends - words.starts
    upto = np.concatenate([[0], np.cumsum(sizes + 1)])
    rows = len(words.bounds) - 1
    at = upto[words.bounds] + np.arange(rows + 1)
    out = np.full(at[-1], 32, np.uint8)
    row = np.repeat(np.arange(rows), np.diff(words.bounds))
    to = upto[:-1] + row
    # Each word's bytes move by one distance.
    index = np.repeat(to - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes, sizes) + np.arange(sizes.sum())
    source = np.repeat(words.starts - to, sizes) + index
    out[index] = _LOWER[words.data[source]]
    out[at[1:] - 1] = _END
    return out, at


def place_codes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each byte, the ``DEPTH`` bytes before it, nearest first, and itself in one number.

    Before the start of a row stand end signs.
    """
    code = np.zeros(len(data), np.uint64)
    starts, ends = at[:-1], at[1:]
    for back in range(1, DEPTH + 1):
        byte = np.full(len(data), _END, np.uint8)
        byte[back:] = data[:-back]
        for k in range(back):
            early = starts + k
            byte[early[early < ends]] = _END
        code = (code << np.uint64(8)) | byte
    return (code << np.uint64(8)) | data


def _tally(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    fresh = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[fresh], np.add.reduceat(counts, fresh)


def place_counts(texts: DataFrame) -> DataFrame:
    """(code, n) over all texts of a one-column frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            code, n = _tally(np.concatenate(codes), np.concatenate(counts))
            for k in range(0, len(code), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(code[k : k + 50_000].view(np.int64)), pa.array(n[k : k + 50_000])], ["code", "n"])

        for batch in batches:
            for _, _, data, rows in chunks(batch.column(0)):
                own = np.sort(place_codes(*canonical(split_words(data, rows))))
                fresh = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                codes.append(own[fresh])
                counts.append(np.diff(np.append(fresh, len(own))))
                size += len(fresh)
                if size > 3_000_000:
                    yield from flush()
                    codes, counts, size = [], [], 0
        if codes:
            yield from flush()

    return texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


class Tree(NamedTuple):
    root: np.ndarray  # probability of each byte
    contexts: list[np.ndarray]  # sorted, by depth - 1
    totals: list[np.ndarray]
    entries: list[np.ndarray]  # sorted (context, byte) codes
    counts: list[np.ndarray]

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        byte = codes & np.uint64(255)
        p = self.root[byte.astype(np.int64)]
        for depth, (contexts, totals, entries, counts) in enumerate(zip(self.contexts, self.totals, self.entries, self.counts), 1):
            if not len(contexts):
                continue
            context = codes >> np.uint64(8 * (1 + DEPTH - depth))
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            mine = np.flatnonzero(contexts[at] == context)
            pair = (context[mine] << np.uint64(8)) | byte[mine]
            found = np.minimum(np.searchsorted(entries, pair), len(entries) - 1)
            n = np.where(entries[found] == pair, counts[found], 0)
            p[mine] = (n + WEIGHT * p[mine]) / (totals[at[mine]] + WEIGHT)
        return p


def tree_levels(level: DataFrame, total: int, least: int = LEAST) -> list[DataFrame]:
    """(code, n, total, p, state) by depth from 0, for the codes of ``level(code, n)`` of which ``total`` were seen.

    The tree in SQL, for tables of any size; ``code_scores`` makes the same numbers with fewer
    shuffles. A code of n = 0 is one that only asks for its probability p. ``state`` marks codes whose
    context is retained; the distribution of any other context is that of the next shorter one.
    """
    levels = {DEPTH: level}
    # The furthest byte goes: it stands just above the next byte.
    shorter = F.expr("((code >> 16) << 8) | (code & 255)")
    for depth in range(DEPTH - 1, -1, -1):
        levels[depth] = saved(levels[depth + 1].groupBy(shorter.alias("code")).agg(F.sum("n").alias("n")), "places")
    n = F.col("n")
    made = [levels[0].select("code", "n", F.lit(total).cast("long").alias("total"), ((n + 1) / F.lit(total + 256.0)).alias("p"), F.lit(False).alias("state"))]
    for depth in range(1, DEPTH + 1):
        own = Window.partitionBy("context")
        child = levels[depth].withColumn("context", F.shiftright("code", 8)).withColumn("total", F.sum("n").over(own))
        parent = made[-1].select(F.col("code").alias("up_code"), F.col("n").alias("up_n"), F.col("total").alias("up_total"), F.col("p").alias("up_p"))
        tested = child.withColumn("up_code", shorter).join(parent, "up_code").withColumn(
            "gain", F.sum(F.expr("CASE WHEN n > 0 THEN n * ln((n / total) / (up_n / up_total)) END")).over(own)
        ).withColumn("kinds", F.count_if(n > 0).over(own))
        # Half a log of the sample for each free parameter, as in the Bayesian criterion.
        state = F.expr(f"coalesce(total >= {least} AND gain > 0.5 * kinds * ln(total) + {_EVEN}, false)")
        p = F.when(F.col("state"), (n + WEIGHT * F.col("up_p")) / (F.col("total") + WEIGHT)).otherwise(F.col("up_p"))
        made.append(saved(tested.withColumn("state", state).select("code", "n", "total", p.alias("p"), "state"), "states"))
    for depth in range(1, DEPTH):
        forget(levels[depth])
    return made


def fit_tree(texts: DataFrame, share: float = 0.0) -> Tree:
    """The tree over all texts of a one-column frame, on the driver, to look at small tables.

    Nulls and empty texts are one end sign. ``share``: contexts that make up less of all places are no states.
    """
    level = saved(place_counts(texts), "places")
    total = level.agg(F.sum("n")).first()[0] or 0
    levels = tree_levels(level, total, max(LEAST, int(np.ceil(share * total))))
    root = np.ones(256)
    for code, n in levels[0].select("code", "n").collect():
        root[code & 255] += n
    contexts, totals, entries, counts = [], [], [], []
    for frame in levels[1:]:
        kept = frame.where("state AND n > 0").select("code", "n", "total").toArrow().sort_by("code")
        code = kept["code"].to_numpy().view(np.uint64)
        context, first = np.unique(code >> np.uint64(8), return_index=True)
        contexts.append(context)
        totals.append(kept["total"].to_numpy()[first].astype(np.float64))
        entries.append(code)
        counts.append(kept["n"].to_numpy().astype(np.float64))
    for frame in levels:
        forget(frame)
    return Tree(root / root.sum(), contexts, totals, entries, counts)


def _pieces(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Groups of rows of about ``_PIECE`` bytes."""
    row = 0
    while row < len(at) - 1:
        end = max(row + 1, int(np.searchsorted(at, at[row] + _PIECE, "right")) - 1)
        yield row, end
        row = end


def _row_codes(data: np.ndarray, at: np.ndarray, a: int, b: int) -> np.ndarray:
    return place_codes(data[at[a] : at[b]], at[a : b + 1] - at[a])


def block_codes(data: np.ndarray, at: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of a block, sorted, and how often the rows learned from hold each."""
    codes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in _pieces(at):
        own = _row_codes(data, at, a, b)
        of = np.repeat(learned[a:b], np.diff(at[a : b + 1]))
        for part, times in ((own[of], 1), (own[~of], 0)):
            if len(part):
                part = np.sort(part)
                fresh = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                codes.append(part[fresh])
                counts.append(times * np.diff(np.append(fresh, len(part))))
    return _tally(np.concatenate(codes), np.concatenate(counts))


def _groups(codes: np.ndarray, groups: int) -> np.ndarray:
    """Group of each code by the four bytes before the next one; ``groups`` is a power of two.

    Codes that share these bytes stay together, so their distances are small.
    """
    return (mix(codes >> np.uint64(24)) & np.uint64(groups - 1)).astype(np.int64)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs that begin at ``starts``, repeated over each run."""
    return np.repeat(np.add.reduceat(values, starts), np.diff(np.append(starts, len(values))))


def _lengthened(n: np.ndarray, context: np.ndarray, up: tuple[np.ndarray, ...], least: int) -> tuple[np.ndarray, ...]:
    """(n, total, p) of the entries of one depth, given those of the next shorter contexts.

    Entries of one context stand together. ``up`` holds, for each entry, the same three
    numbers of the entry with the furthest byte of its context left out.
    """
    up_n, up_total, up_p = up
    starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    total, seen = _sums(n, starts), n > 0
    gains = np.zeros(len(n))
    gains[seen] = n[seen] * np.log((n[seen] / total[seen]) / (up_n[seen] / up_total[seen]))
    # Half a log of the sample for each free parameter, as in the Bayesian criterion.
    free = 0.5 * _sums(seen.astype(np.int64), starts) * np.log(np.maximum(total, 1))
    state = (total >= least) & (_sums(gains, starts) > free + _EVEN)
    return n, total, np.where(state, (n + WEIGHT * up_p) / (total + WEIGHT), up_p)


def probabilities_of(codes: np.ndarray, n: np.ndarray, first: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The tree's probability of each code; ``codes`` are sorted and share the two bytes before the next one.

    They must be all codes with these two bytes. ``first[c, b]`` counts byte b after byte c in the whole table.
    """
    near = int(codes[0] >> np.uint64(8 * DEPTH)) & 255
    root = first.sum(axis=0)
    row = np.zeros(256, np.uint64)
    shortest = (root, np.full(256, root.sum()), (root + 1) / (root.sum() + 256.0))
    above = _lengthened(first[near], row, shortest, least)
    levels, links = [(codes, n)], []
    for _ in range(DEPTH, 2, -1):
        code, count = levels[-1]
        shorter, link = np.unique((code >> np.uint64(16) << np.uint64(8)) | (code & np.uint64(255)), return_inverse=True)
        levels.append((shorter, np.bincount(link, weights=count).astype(np.int64)))
        links.append(link)
    links.append((levels[-1][0] & np.uint64(255)).astype(np.int64))
    for (code, count), link in zip(reversed(levels), reversed(links)):
        above = _lengthened(count, code >> np.uint64(8), tuple(part[link] for part in above), least)
    return above[2]


def code_scores(made: DataFrame) -> tuple[DataFrame, int]:
    """(block, grp, logs) for the codes of each block and group, in order of code, and the number of groups.

    All contexts that end in the same two bytes are shortened and tested in one task; what
    shorter contexts need is a table of at most 65,536 counts.
    """
    n_bytes = made.agg(F.sum("n_bytes")).first()[0] or 0
    groups = 1 << max(0, int(np.ceil(np.log2(max(1, n_bytes) / GROUP_BYTES))))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                codes, counts = block_codes(*_content(batch.column(1)[k], batch.column(2)[k], batch.column(3)[k]))
                grp = _groups(codes, groups)
                order = np.argsort(grp, kind="stable")
                held, starts = np.unique(grp[order], return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(held), batch.column(0)[k].as_py())), pa.array(held.astype(np.int32)),
                        pa.array([_packed_codes(own) for own in np.split(codes[order], starts[1:])], pa.binary()),
                        pa.array([_packed(own) for own in np.split(counts[order], starts[1:])], pa.binary()),
                    ],
                    ["block", "grp", "codes", "counts"],
                )

    asked = saved(
        made.select("block", "payload", "bounds_at", "held").mapInArrow(ask, "block long, grp int, codes binary, counts binary"), "asked"
    )

    def tally(own: pa.Table) -> pa.Table:
        codes, counts = _tally(np.concatenate(_each(own["codes"], _unpacked_codes)), np.concatenate(_each(own["counts"], _unpacked)).astype(np.int64))
        pair, starts = np.unique(codes >> np.uint64(8 * DEPTH - 8), return_index=True)
        return pa.table({
            "pair": pair.astype(np.int32),
            "grp": pa.array(np.full(len(pair), own["grp"][0].as_py(), np.int32)),
            "codes": pa.array([_packed_codes(c) for c in np.split(codes, starts[1:])], pa.binary()),
            "counts": pa.array([_packed(c, "<i8") for c in np.split(counts, starts[1:])], pa.binary()),
        })

    level = saved(asked.groupBy("grp").applyInArrow(tally, "pair int, grp int, codes binary, counts binary"), "places")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for near, codes, counts in zip((batch.column(0).to_numpy() >> 8).tolist(), _each(batch.column(1), _unpacked_codes), _each(batch.column(2), _counts)):
                first[near << 8 : (near + 1) << 8] += np.bincount((codes & np.uint64(255)).astype(np.int64), counts, 256).astype(np.int64)
        at = np.flatnonzero(first)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(first[at])], ["at", "n"])

    summed = level.select("pair", "codes", "counts").mapInArrow(pairs, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    first = np.zeros(1 << 16, np.int64)
    first[summed["at"].to_numpy()] = summed["n"].to_numpy()
    first = first.reshape(256, 256)

    def chain(own: pa.Table) -> pa.Table:
        parts = _each(own["codes"], _unpacked_codes)
        codes = np.concatenate(parts)
        order = np.argsort(codes, kind="stable")
        logs = np.empty(len(codes), np.float32)
        logs[order] = np.log10(probabilities_of(codes[order], np.concatenate(_each(own["counts"], _counts))[order], first))
        cuts = np.cumsum([len(part) for part in parts])[:-1]
        return pa.table({"grp": own["grp"], "codes": own["codes"], "logs": pa.array([_packed(part, "<f4") for part in np.split(logs, cuts)], pa.binary())})

    probable = level.groupBy("pair").applyInArrow(chain, "grp int, codes binary, logs binary")

    def answer(own: pa.Table, known: pa.Table) -> pa.Table:
        codes, logs = np.concatenate(_each(known["codes"], _unpacked_codes)), np.concatenate(_each(known["logs"], _logs))
        order = np.argsort(codes, kind="stable")
        codes, logs = codes[order], logs[order]
        found = [_packed(logs[np.searchsorted(codes, mine)], "<f4") for mine in _each(own["codes"], _unpacked_codes)]
        return pa.table({"block": own["block"], "grp": own["grp"], "logs": pa.array(found, pa.binary())})

    answers = asked.select("block", "grp", "codes").groupBy("grp").cogroup(probable.groupBy("grp")).applyInArrow(answer, "block long, grp int, logs binary")
    return answers, groups


def word_counts(made: DataFrame, groups: int) -> DataFrame:
    """(block, grp, c, n, kinds): counts of the block's distinct words in the rows learned from, in order of word.

    ``n`` and ``kinds`` are occurrences and distinct words of the group, on one of its rows. A
    group is a range of hashes, so that the groups of a block in order hold its words in order.
    """
    bits = groups.bit_length() - 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data, at, learned = _content(batch.column(1)[k], batch.column(2)[k], batch.column(3)[k])
                own = [split_words(data[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in _pieces(at)]
                words, slot = np.unique(mix(np.concatenate([part.hashes for part in own])), return_inverse=True)
                lengths = np.concatenate([np.diff(part.bounds) for part in own])
                trained = np.bincount(slot[np.repeat(learned, lengths)], minlength=len(words))
                held, starts = np.unique(words >> np.uint64(1) >> np.uint64(63 - bits), return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(held), batch.column(0)[k].as_py())), pa.array(held.astype(np.int32)),
                        pa.array([_packed_codes(own) for own in np.split(words, starts[1:])[: len(held)]], pa.binary()),
                        pa.array([_packed(own) for own in np.split(trained, starts[1:])[: len(held)]], pa.binary()),
                    ],
                    ["block", "grp", "words", "trained"],
                )

    def tally(own: pa.Table) -> pa.Table:
        parts = _each(own["words"], _unpacked_codes)
        distinct, at = np.unique(np.concatenate(parts), return_inverse=True)
        c = np.bincount(at, np.concatenate(_each(own["trained"], _unpacked)), len(distinct)).astype(np.int64)
        first = np.arange(own.num_rows) == 0
        cuts = np.cumsum([len(part) for part in parts])[:-1]
        return pa.table({
            "block": own["block"], "grp": own["grp"], "c": pa.array([_packed(part, "<i8") for part in np.split(c[at], cuts)], pa.binary()),
            "n": first * c.sum(), "kinds": first * (c > 0).sum(),
        })

    asked = made.select("block", "payload", "bounds_at", "held").mapInArrow(ask, "block long, grp int, words binary, trained binary")
    return asked.groupBy("grp").applyInArrow(tally, "block long, grp int, c binary, n long, kinds long")


def _content(payload: pa.Scalar, at: pa.Scalar, held: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical bytes of a block, bounds of its rows, and which of them are learned from."""
    data = np.frombuffer(zstandard.decompress(payload.as_py()), np.uint8)
    learned = np.array([h is False for h in held.as_py()], bool)
    return data, at.values.to_numpy(zero_copy_only=False), learned


def _packed(values: np.ndarray, kind: str = "<i4") -> bytes:
    """Numbers, compressed; integers plane by plane, as high bytes of small numbers are all alike."""
    if kind == "<f4":
        return zstandard.compress(values.astype(kind).tobytes(), 1)
    own = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(-1, np.dtype(kind).itemsize)
    return zstandard.compress(np.ascontiguousarray(own.T).tobytes(), 1)


def _unpacked(data: bytes, kind: str = "<i4") -> np.ndarray:
    if kind == "<f4":
        return np.frombuffer(zstandard.decompress(data), kind)
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _packed_codes(codes: np.ndarray) -> bytes:
    """Sorted codes by their distances."""
    return _packed(np.diff(codes, prepend=np.uint64(0)), "<u8")


def _unpacked_codes(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, "<u8"), dtype=np.uint64)


def _counts(data: bytes) -> np.ndarray:
    return _unpacked(data, "<i8")


def _logs(data: bytes) -> np.ndarray:
    return _unpacked(data, "<f4")


def _each(column: pa.ChunkedArray | pa.Array, unpack: Callable[[bytes], np.ndarray]) -> list[np.ndarray]:
    return [unpack(value.as_py()) for value in column]


_BLOCK = (
    "docs array<long>, known array<boolean>, held array<boolean>, payload binary, bounds_at array<long>, n_bytes long, n_words array<long>, "
    "slots binary, repeats binary, bounds array<long>"
)


def blocks(docs: DataFrame) -> DataFrame:
    """(block, ...) of (doc_id, text, held_out): documents in blocks with their distinct words and bytes."""
    names = [part.split()[0] for part in _BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, parts, hashes, sizes, size = [], [], [], [], [], 0

        def close() -> pa.RecordBatch:
            words, lengths = mix(np.concatenate(hashes)), np.concatenate(sizes)
            distinct, slot = np.unique(words, return_inverse=True)
            row = np.repeat(np.arange(len(lengths)), lengths)
            # Distinct words of each row with their number of times there.
            pairs, times = np.unique(row.astype(np.int64) * max(1, len(distinct)) + slot, return_counts=True)
            bounds = np.searchsorted(pairs, np.arange(len(lengths) + 1) * max(1, len(distinct)))
            data = np.concatenate([part for part, _ in parts])
            at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(own) for _, own in parts]))])
            lists = pa.list_(pa.int64())
            columns = [
                pa.array([[i if i is not None else 0 for i in ids]], lists), pa.array([[i is not None for i in ids]], pa.list_(pa.bool_())),
                pa.array([held], pa.list_(pa.bool_())), pa.array([zstandard.compress(data.tobytes(), 6)], pa.binary()),
                pa.array([at], lists), pa.array([len(data)], pa.int64()),
                pa.array([lengths], lists),
                pa.array([_packed(np.diff(pairs % max(1, len(distinct)), prepend=0))], pa.binary()),
                pa.array([_packed(times)], pa.binary()), pa.array([bounds], lists),
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            doc_ids, outs = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, b, data, rows in chunks(batch.column(1)):
                words = split_words(data, rows)
                parts.append(canonical(words))
                hashes.append(words.hashes)
                sizes.append(np.diff(words.bounds))
                ids += doc_ids[a:b]
                held += outs[a:b]
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield close()
                    ids, held, parts, hashes, sizes, size = [], [], [], [], [], 0
        if ids:
            yield close()

    return docs.mapInArrow(run, _BLOCK).withColumn("block", F.monotonically_increasing_id())


_SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def score_texts(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs(doc_id, text)``.

    Learns from the rows whose crc32 of doc_id, modulo ``folds``, is not ``held``. Tokens are
    words and one end. ``base_score`` sums log10((c + 1) / (N + V + 1)), ``score`` is the
    tree's log10 probability of the text. Null counts as empty: one token, the end. Rows
    without doc_id have a null held_out and are not learned from; repeated rows count each
    time. Other columns are ignored; an empty table gives no rows.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % folds == held
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", fold.alias("held_out"))
    made = saved(blocks(texts), "blocks")
    scored, groups = code_scores(made)
    answers = saved(word_counts(made, groups), "answers")
    words, kinds = answers.agg(F.sum("n"), F.sum("kinds")).first()
    ends = made.select(F.explode("held").alias("h")).where("NOT h").count()
    total, distinct = (words or 0) + ends, (kinds or 0) + (ends > 0)
    floor = float(np.log10(total + distinct + 1))
    names = [part.split()[0] for part in _SCORED.split(", ")]

    def run(own: pa.Table, answered: pa.Table) -> pa.Table:
        answered = answered.sort_by("grp")
        by_word, by_code = (answered.filter(pc.is_valid(answered[name])) for name in ("c", "logs"))
        counts = np.concatenate([np.zeros(0, np.int64), *_each(by_word["c"], _counts)])
        columns: list[list] = [[] for _ in names]
        for row in range(own.num_rows):
            get = lambda name: own[name][row].values.to_numpy(zero_copy_only=False)
            slots = np.cumsum(_unpacked(own["slots"][row].as_py()))
            times = _unpacked(own["repeats"][row].as_py())
            c = counts[slots]
            bounds = get("bounds")
            logs = np.concatenate([[0.0], np.cumsum(times * np.log10(c + 1.0))])
            known = np.concatenate([[0], np.cumsum(times * (c > 0))])
            tokens = get("n_words") + 1
            base = logs[bounds[1:]] - logs[bounds[:-1]] + np.log10(ends + 1.0) - tokens * floor
            data, at, learned = _content(own["payload"][row], own["bounds_at"][row], own["held"][row])
            codes, _ = block_codes(data, at, learned)
            logs_of = np.empty(len(codes))
            logs_of[np.argsort(_groups(codes, groups), kind="stable")] = np.concatenate(_each(by_code["logs"], _logs))
            score = np.empty(len(at) - 1)
            for a, b in _pieces(at):
                places = _row_codes(data, at, a, b)
                order = np.argsort(places)
                value = np.empty(len(places))
                # Looked up in order, as neighbours lie close together.
                value[order] = logs_of[np.searchsorted(codes, places[order])]
                score[a:b] = np.add.reduceat(value, at[a:b] - at[a])
            doc = pa.array(get("docs"), mask=~get("known").astype(bool))
            parts = [
                doc, own["held"][row].values, pa.array(tokens), pa.array(known[bounds[1:]] - known[bounds[:-1]] + (ends > 0)),
                pa.array(np.full(len(tokens), total)), pa.array(base), pa.array(score),
            ]
            for column, part in zip(columns, parts):
                column.append(part)
        kinds_ = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.chunked_array(c, k) for c, k in zip(columns, kinds_)], names)

    needed = made.select("block", "docs", "known", "held", "payload", "bounds_at", "n_words", "slots", "repeats", "bounds")
    none = F.lit(None).cast("binary")
    given = answers.select("block", "grp", "c", none.alias("logs")).union(scored.select("block", "grp", none, "logs"))
    return needed.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(run, _SCORED)
