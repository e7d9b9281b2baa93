"""Exact top-k by inner product, by the threshold algorithm over sorted lists.

Candidates lie in blocks of bounded size. In a block every dimension has its list of rows in
order of value. A query reads all lists from its better end, step by step; rows met are scored
in full at once, and the weighted values where the lists stand bound the score of every row
not met. A query is done with a block when that bound is below its k-th score. Query blocks
meet candidate blocks, and the best of each block are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Rows of a block, on average.
CANDIDATES, QUERIES = 16_384, 8_192
#: Rows that the first step reads from each list; every further step reads twice as many.
FIRST_STEP = 16


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of each component, as double, one row per id.

    Vectors that are null or empty or hold null or non-finite components are left out, and so
    are rows without an id. Of rows that repeat an id the smallest vector counts.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: F.coalesce((c == c) & (F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)))
    kept = rows.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where("id is not null and x is not null").where(fine & (F.size("x") > 0))
    return kept.groupBy("id").agg(F.min(F.transform("x", lambda c: F.floor(c * scale).cast("long"))).alias("v"))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    at = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dims), np.int64)
    row = np.repeat(np.arange(len(lists)), np.diff(at))
    out[row, np.arange(at[0], at[-1]) - np.repeat(at[:-1], np.diff(at))] = flat[at[0] : at[-1]]
    return out


def threshold_search(query: np.ndarray, own: int, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the k best rows but ``own``, ties to the smaller id, and the rows scored.

    ``vectors``: in any order; ``order[j]``: rows by ascending value of dimension j.
    """
    n = len(ids)
    used = np.flatnonzero(query)
    seen = ids == own
    met, best = np.zeros(0, np.int64), np.zeros(0, vectors.dtype)
    depth, step = 0, FIRST_STEP
    scored = 0
    while True:
        to = min(n, depth + step)
        reads = [order[j, n - to : n - depth] if query[j] > 0 else order[j, depth:to] for j in used]
        fresh = np.concatenate(reads) if reads else np.arange(n)
        seen_before = seen.copy()
        seen[fresh] = True
        new = np.flatnonzero(seen & ~seen_before)
        if len(new):
            scored += len(new)
            score = vectors[new] @ query
            rows, scores = np.concatenate([met, new]), np.concatenate([best, score])
            top = np.lexsort((ids[rows], -scores))[:k]
            met, best = rows[top], scores[top]
        depth, step = to, 2 * step
        if depth == n or seen.all() or not len(used):
            break
        edge = sum(int(query[j]) * int(vectors[order[j, n - depth] if query[j] > 0 else order[j, depth - 1], j]) for j in used)
        if len(best) == k and best[-1] > edge:
            break
    return ids[met], best, scored


_FOUND = "query_id long, vec_id long, score long"


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, all if fewer.

    Both tables are (id, v) with unique ids and integer components; shorter vectors count as
    padded with zeros. A candidate with the query's id is its own row and left out. Ties go to
    the smaller id. Queries without a candidate, and empty tables, give no rows.
    """
    n, dims = candidates.agg(F.count("*"), F.max(F.size("v"))).first()
    m, wide = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    dims = max(dims or 1, wide or 1)
    row_blocks, query_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))

    def blocks(rows: DataFrame, mine: str, own: int, other: str, others: int) -> DataFrame:
        return rows.withColumn(mine, F.pmod(F.xxhash64("id"), F.lit(own)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        )

    def search(asked: pa.Table, found: pa.Table) -> pa.Table:
        ids, vectors = found["id"].to_numpy(), _matrix(found["v"], dims)
        order = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32, order="C") if len(ids) else None
        parts: list[tuple] = []
        if order is not None:
            exact = vectors.astype(np.float64) if np.abs(vectors).max(initial=0) < 2**20 else vectors
            for own, query in zip(asked["id"].to_pylist(), _matrix(asked["v"], dims)):
                small = np.abs(query).max(initial=0) * float(np.abs(vectors).max(initial=0)) * dims < 2**53
                names, scores, _ = threshold_search(query.astype(exact.dtype) if small else query, own, ids, exact if small else vectors, order, k)
                parts.append((np.full(len(names), own), names, scores.astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], ["query_id", "vec_id", "score"])

    key = ["q_block", "c_block"]
    asked = blocks(queries, "q_block", query_blocks, "c_block", row_blocks).groupBy(*key)
    offered = blocks(candidates, "c_block", row_blocks, "q_block", query_blocks).groupBy(*key)
    found = asked.cogroup(offered).applyInArrow(search, _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
