"""Rows whose key is in a set of any size, without shuffling the rows.

A bit map of fixed size over hashes of the set is broadcast as a table of at most ``SLOTS``
rows. It passes every member and a small share of the others, so an exact join may follow on
what is left. The size of the set changes that share, never the result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit words of the map: 2 MB, 2^24 bits.
SLOTS = 1 << 18


def _slot(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 46)


def bit_map(hashes: DataFrame) -> DataFrame:
    """(slot, bits) of a one-column frame of 64-bit hashes ``h``; at most ``SLOTS`` rows."""
    one = F.expr("shiftleft(1L, cast(h & 63 as int))")
    return hashes.groupBy(_slot(F.col("h")).cast("int").alias("slot")).agg(F.bit_or(one).alias("bits"))


def bit_array(hashes: DataFrame) -> np.ndarray:
    """The same map as an array of ``SLOTS`` words for use inside tasks."""
    table = np.zeros(SLOTS, np.uint64)
    for slot, bits in bit_map(hashes).collect():
        table[slot] = np.uint64(bits & 0xFFFFFFFFFFFFFFFF)
    return table


def passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which 64-bit hashes the map lets through."""
    return (table[(h >> np.uint64(46)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) != 0


def _marked(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` with ``__near``: whether the map lets the key through."""
    table = bit_map(wanted.select(F.xxhash64("h").alias("h"))).toDF("__slot", "__bits")
    hashed = rows.withColumn("__hash", F.xxhash64(F.col(key).cast("long"))).withColumn("__slot", _slot(F.col("__hash")).cast("int"))
    passed = F.expr("coalesce(shiftrightunsigned(__bits, cast(__hash & 63 as int)) & 1 = 1, false)")
    return hashed.join(F.broadcast(table), "__slot", "left").withColumn("__near", passed & F.col(key).isNotNull())


def _wanted(members: DataFrame) -> DataFrame:
    (name,) = members.columns
    return members.select(F.col(name).cast("long").alias("h")).where("h is not null").distinct()


def only_members(rows: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """Rows whose ``key`` is in the one column of ``members``; null keys are in no set."""
    wanted = _wanted(members)
    near = _marked(rows, key, wanted).where("__near").select(*rows.columns)
    return near.join(wanted.withColumnRenamed("h", key), key, "left_semi").select(*rows.columns)


def without_members(rows: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """Rows whose ``key`` is not in the one column of ``members``; null keys stay."""
    wanted = _wanted(members)
    marked = _marked(rows, key, wanted)
    far = marked.where("NOT __near").select(*rows.columns)
    near = marked.where("__near").select(*rows.columns)
    return far.union(near.join(wanted.withColumnRenamed("h", key), key, "left_anti").select(*rows.columns))
