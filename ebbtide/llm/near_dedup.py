"""Near-duplicate documents by circulant MinHash, confirmed on whole shingle sets.

Two fixed permutations make all signature coordinates: ``sigma`` scatters a shingle over
2^32 places, and coordinate k is the smallest value of ``pi``, shifted circularly by k
places, over the set. Coordinates are cut into bands; sets that agree on a band are
candidates, and a candidate counts only if its full sets are similar enough.

Copies with one and the same set are folded into their smallest id before banding, so a
group of thousands of exact copies is one row. Within a band's bucket, members are compared
with one hub; whatever the links found so far leave in different components is compared with
a second, random hub, and what still differs then is joined exactly by what it has in common
in its differences to a hub, screened by sketches of the sets. Members of one component need no further comparison, so no group of near copies is
expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.components import components
from ebbtide.llm.membership import only_members
from ebbtide.llm.scratch import saved, saved_in_batches
from ebbtide.llm.words import chunks, mix, run_hash, shingle_hashes, split_words

#: Bands and coordinates of each. A pair at similarity 0.8 misses all bands with probability 3.2e-6.
BANDS, ROWS = 24, 4

#: Growth of the classes of difference sizes.
_CLASS = 1.25

_TILE = 512

#: Bits of the sketch that pairs are screened by before their sets are read.
SKETCH_BITS = 256


def _pi(x: np.ndarray) -> np.ndarray:
    """The second permutation, on 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash of a set of 64-bit shingle hashes (at least one)."""
    places = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    low = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(places), _TILE):
        np.minimum(low, _pi(places[None, at : at + _TILE] - shifts).min(axis=1), out=low)
    return low


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; different bands never share keys by design."""
    parts = sig.reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return key


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    for _, _, data, rows in chunks(column):
        words = split_words(data, rows)
        hashes, at = shingle_hashes(words, width)
        for r in range(len(rows) - 1):
            lo, hi = words.bounds[r], words.bounds[r + 1]
            if at[r] < at[r + 1]:
                yield np.unique(hashes[at[r] : at[r + 1]])
            elif lo < hi:
                yield np.array([run_hash(words.hashes[lo:hi])], np.uint64)
            else:
                yield hashes[:0]


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Which of ``SKETCH_BITS`` cells an odd number of shingles falls into, as 64-bit words.

    The sketch of a symmetric difference is the exclusive or of the two sketches, so sets
    that differ in x shingles have sketches that differ in x bits or fewer.
    """
    cells = (mix(shingles ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = np.bincount(cells, minlength=SKETCH_BITS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.uint64)


def _list(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def sketched(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """One row per input row: id, set size, two fingerprints of the set, its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, one, two, keys = [], [], [], []
            for s in _sets(batch.column(1), width):
                size.append(len(s))
                one.append(int(np.add.reduce(mix(s), dtype=np.uint64).view(np.int64)))
                two.append(int(np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64).view(np.int64)))
                keys.append(band_keys(signature(s, bands * rows), bands, rows) if len(s) else s[:0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), _list(keys)],
                ["id", "n", "one", "two", "keys"],
            )

    return docs.mapInArrow(run, "id long, n long, one long, two long, keys array<long>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, shingles, odd) of (id, text); ``odd`` is the sketch of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One chunk of text at a time: whole sets of a batch would be many times its signatures.
            for row, end, _, _ in chunks(batch.column(1)):
                part = batch.slice(row, end - row)
                sets = list(_sets(part.column(1), width))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _list(sets), _list([odd_sketch(s) for s in sets])], ["id", "shingles", "odd"]
                )

    return docs.mapInArrow(run, "id long, shingles array<long>, odd array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets share at least ``percent`` of their union."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return (
        pairs.join(left, "a").join(right, "b")
        .where(100 * both >= percent * (F.size("of_a") + F.size("of_b") - both))
        .select("a", "b")
    )


def _sizes_allow(left: str, right: str, percent: int) -> Column:
    """Sizes alone allow the similarity."""
    return (100 * F.least(left, right) >= percent * F.greatest(left, right))


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(v, label) of the vertices of ``labels`` and ``links(a, b)``, once ``links`` have joined the components.

    Only one vertex for each component takes part, so many links between two components count once.
    """
    if labels is None:
        return components(saved(links, "links"))
    ends = links
    for end in ("a", "b"):
        ends = ends.join(labels.toDF(end, f"label_{end}"), end, "left").withColumn(f"label_{end}", F.coalesce(f"label_{end}", end))
    merged = components(saved(ends.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct(), "links"))
    known = labels.select("v").union(merged.select("v")).distinct().join(labels, "v", "left").select("v", F.coalesce("label", "v").alias("old"))
    return saved(known.join(merged.toDF("old", "new"), "old", "left").select("v", F.coalesce("new", "old").alias("label")), "joined")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of those buckets that still hold more than one component."""
    known = members.join(labels.withColumnRenamed("v", "id"), "id", "left").select(
        "key", "id", "n", F.coalesce("label", "id").alias("label")
    )
    mixed = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return saved(known.join(mixed.select("key"), "key", "left_semi"), "mixed")


def near_duplicate_labels(sketch: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(v, label): the folded sets with a confirmed link, and the smallest id of their component.

    ``sketch``: (id, n, keys), one row per distinct set; ``docs``: (id, text).
    """
    keyed = sketch.select("id", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("id", "n")).alias("hub")).where("members > 1")
    members = saved(keyed.join(shared.select("key", "hub"), "key"), "buckets")
    sets = saved_in_batches(
        shingle_sets(only_members(docs, "id", members.select("id")).dropDuplicates(["id"]), width), "sets"
    )

    def stars(rows: DataFrame) -> DataFrame:
        return (
            rows.where(F.col("hub.id") != F.col("id")).where(_sizes_allow("hub.n", "n", percent))
            .select(F.least("hub.id", "id").alias("a"), F.greatest("hub.id", "id").alias("b")).distinct()
        )

    labels = _joined(None, _confirmed(stars(members), sets, percent))
    mixed = _mixed(members.select("key", "id", "n"), labels)
    draw = F.struct(F.xxhash64("id", "key").alias("draw"), "id", "n", "label")
    hubs = mixed.groupBy("key").agg(F.min(draw).alias("hub"))
    apart = mixed.join(hubs, "key").where(F.col("hub.label") != F.col("label"))
    labels = _joined(labels, _confirmed(stars(apart), sets, percent))
    mixed = _mixed(mixed.select("key", "id", "n"), labels)
    return _joined(labels, _confirmed(_differing_alike(mixed, sets, percent), sets, percent))


def _differing_alike(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) from different components of a bucket.

    Members of a dense bucket resemble its hub, so nearly all their pairs share shingles. What
    tells the similar pairs is how members differ from the hub. Two sets u, v with the wanted
    similarity differ in at most x = (|u| + |v|) (1 - t) / (1 + t) shingles, so their differences
    to the hub, of sizes d and e at most x apart, have (d + e - x) / 2 or more in common. That is
    positive if one of the two is not similar to the hub, and if both are, they are in the hub's
    component. The pairs are found by a prefix filter: with the rarest shingles of a hub's
    differences first, the first d - o + 1 and e - o + 1 share one if o are common. As o depends
    on both sizes, a set gives one prefix for each class of sizes its partner may have.

    The hub of a bucket is the first member of its smallest component, inside the bucket or not:
    buckets over one group of copies then share a hub, and a pair meets once for it, not once for
    each bucket. What shares a prefix is screened by the sketches of the whole sets within the
    join, so that only pairs whose sets can be similar leave it.
    """
    hubs = mixed.groupBy("key").agg(F.min("label").alias("hub"))
    frames = mixed.join(hubs, "key").where("id <> hub").select(
        "hub", "id", "n", "label", (F.col("label") == F.col("hub")).alias("inside")
    ).distinct()
    mine, hub = F.col("mine"), F.col("of_hub")
    differences = saved(
        frames.join(sets.select("id", F.col("shingles").alias("mine")), "id")
        .join(sets.select(F.col("id").alias("hub"), F.col("shingles").alias("of_hub")), "hub")
        .select("hub", "id", F.explode(F.concat(F.array_except(mine, hub), F.array_except(hub, mine))).alias("s")), "differences",
    )
    common = differences.groupBy("hub", "s").agg(F.count("*").alias("sets"))
    largest = frames.groupBy("hub").agg(F.max("n").alias("most"))
    ordered = (
        differences.join(common, ["hub", "s"]).groupBy("hub", "id").agg(F.sort_array(F.collect_list(F.struct("sets", "s"))).alias("o"))
        .join(frames, ["hub", "id"]).join(largest, "hub")
        # Shingles of one set alone come first, take their places in the prefix, and join with nothing.
        .select("hub", "id", "n", "label", "inside", "most", F.size("o").cast("long").alias("d"), F.expr("transform(filter(o, v -> v.sets > 1), v -> v.s)").alias("shared"))
    )
    least = percent / 100
    slack = (1 - least) / (1 + least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = [1]
        for batch in batches:
            shared = batch.column(7)
            hub_of = mix(batch.column(0).to_numpy().view(np.uint64))
            keys = []
            for r, (n, most, d) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 5, 6)))):
                own = shared[r].values.to_numpy().view(np.uint64)
                x = int(slack * (n + min(most, n / least)) + 1e-6)
                while edges[-1] <= d + x:
                    edges.append(max(edges[-1] + 1, int(edges[-1] * _CLASS)))
                size_class = np.searchsorted(edges, d, "right")
                made = [own[:0]]
                for k in range(np.searchsorted(edges, max(1, d - x), "right"), np.searchsorted(edges, d + x, "right") + 1):
                    need = max(1, -((x - d - max(edges[k - 1], d - x)) // 2))
                    if need <= min(d, edges[k] - 1):
                        pair = np.array([min(k, size_class) << 32 | max(k, size_class)], np.uint64)
                        prefix = max(0, d - need + 1 - (d - len(own)))
                        made.append(mix(own[:prefix] ^ mix(hub_of[r] + mix(pair))))
                keys.append(np.concatenate(made))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 2, 3, 4, 6)), _list(keys)], ["hub", "id", "n", "label", "inside", "d", "keys"])

    words = [f"w{k}" for k in range(SKETCH_BITS // 64)]
    keyed = saved_in_batches(
        ordered.mapInArrow(run, "hub long, id long, n long, label long, inside boolean, d long, keys array<long>")
        .join(sets.select("id", *(F.col("odd")[k].alias(f"w{k}") for k in range(SKETCH_BITS // 64))), "id")
        .select("id", "n", "label", "inside", "d", *words, F.explode("keys").alias("key")), "prefixes",
    )
    other = keyed.where("NOT inside").select(
        F.col("key").alias("key_b"), F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("label").alias("label_b"), F.col("d").alias("d_b"),
        *(F.col(w).alias(f"{w}_b") for w in words),
    )
    bits = F.expr(" + ".join(f"bit_count({w} ^ {w}_b)" for w in words))
    screened = bits * (100 + percent) <= (F.col("n") + F.col("n_b")) * (100 - percent)
    apart = F.abs(F.col("d") - F.col("d_b")) * (100 + percent) <= (F.col("n") + F.col("n_b")) * (100 - percent)
    once = F.col("inside") | (F.col("id") < F.col("b"))
    return (
        keyed.join(other, (F.col("key") == F.col("key_b")) & once & (F.col("label") != F.col("label_b")) & _sizes_allow("n", "n_b", percent) & apart & screened)
        .select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id, kept).

    A set holds the distinct ``width``-word shingles of a lower-cased text, or its whole word
    sequence if shorter; sets with 100 * intersection >= percent * union are linked.
    ``component_id`` is the smallest id reachable over links, and ``kept`` marks that id.

    Null, empty and blank texts have an empty set and are linked with nothing. Rows that
    repeat an id and text get equal results. Rows without an id are always kept, with the
    component of the texts they equal, or null; they link nothing. All other columns are ignored.
    An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = saved_in_batches(sketched(texts, width, bands, rows), "sketch")
    folded = saved(
        sketch.where("n > 0 and id is not null").groupBy("one", "two", "n").agg(F.min("id").alias("id"), F.first("keys").alias("keys")),
        "folded",
    )
    labels = near_duplicate_labels(folded, texts.where("id is not null"), width, percent).withColumnRenamed("v", "rep")
    classes = folded.select("one", "two", "n", F.col("id").alias("rep")).join(labels, "rep", "left").select(
        "one", "two", "n", F.coalesce("label", "rep").alias("label")
    )
    return sketch.join(classes, ["one", "two", "n"], "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("label", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("label", "id"), F.lit(True)).alias("kept"),
    )
