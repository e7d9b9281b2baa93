"""Exact ranks, order statistics and running totals without a single big sort.

``percentile`` keeps every distinct value of a column in one buffer, and a window
without partitions moves every row to one task. Both fail on billions of users. The
operators here look at a small summary first (approximate quantiles or bucket counts,
read as literals) and then sort only the rows that the summary cannot decide, or sort
many small buckets side by side. Results are exact in every case.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.functions.columns import number
from ebbtide.functions.draws import uniform


# --- order statistics -------------------------------------------------------------

def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of the non-null values of each column."""
    def ranks(count: int, prob: float) -> tuple[int, int]:
        spot = (count - 1) * prob
        return math.floor(spot), math.ceil(spot)

    data = df.select(*[number(F.col(c)).alias(c) for c in columns])
    found, counts = _values_at_ranks(data, columns, probs, ranks)

    def interpolate(column: str, i: int) -> float | None:
        if not counts[column]:
            return None
        low, high = found[column, i]
        spot = (counts[column] - 1) * probs[i]
        return low + (high - low) * (spot - math.floor(spot))

    return {c: [interpolate(c, i) for i in range(len(probs))] for c in columns}


def value_at_share(df: DataFrame, column: str, share: float, at_least: int = 1):
    """The value that ends the first ``max(at_least, int(share * n))`` values in order."""
    def ranks(count: int, prob: float) -> tuple[int, int]:
        rank = min(count, max(at_least, int(prob * count))) - 1
        return rank, rank

    found, counts = _values_at_ranks(df.select(column), [column], [share], ranks)
    return found[column, 0][0] if counts[column] else None


def _literal(value) -> str:
    return f"{value}L" if isinstance(value, int) else f"CAST('{value!r}' AS double)"


def _values_at_ranks(df: DataFrame, columns: list[str], probs: list[float], ranks) -> tuple[dict, dict]:
    """Values at zero-based ranks: ``ranks(count, prob)`` gives a (low, high) pair.

    A band around each quantile comes from an approximate sketch. Rows below the band
    are only counted; rows inside it, about 0.2 % of all, are grouped by value and
    ranked. A band that misses its rank is widened until it holds it, so the sketch
    decides the cost and never the result.
    """
    if not columns:
        return {}, {}
    # Read several times below, and only these columns.
    data = df.persist()
    try:
        return _ranked_values(data, columns, probs, ranks)
    finally:
        data.unpersist()


def _ranked_values(data, columns, probs, ranks) -> tuple[dict, dict]:
    counts = data.agg(*[F.expr(f"count({c}) AS {c}") for c in columns]).first().asDict()
    present = [(c, i) for c in columns if counts[c] for i in range(len(probs))]
    wanted = {(c, i): ranks(counts[c], probs[i]) for c, i in present}
    bands, below, todo = {}, {}, list(present)
    margin = 0.001
    while todo:
        _find_bands(data, todo, probs, counts, margin, bands)
        edges = [e for k, key in enumerate(todo) for e in (
            f"count_if({key[0]} < {_literal(bands[key][0])}) AS below_{k}",
            f"count_if({key[0]} <= {_literal(bands[key][1])}) AS upto_{k}",
        )]
        sides = data.agg(*[F.expr(e) for e in edges]).first()
        below.update({key: sides[f"below_{k}"] for k, key in enumerate(todo)})
        todo = [
            key for k, key in enumerate(todo)
            if not (below[key] <= wanted[key][0] and wanted[key][1] < sides[f"upto_{k}"])
        ]
        margin *= 32
    found = _pick(data, present, bands, {k: [r - below[k] for r in wanted[k]] for k in present})
    return found, counts


def _find_bands(data, keys, probs, counts, margin, bands) -> None:
    sketches = []
    for k, (c, i) in enumerate(keys):
        # Wide enough to reach the neighbouring value in a small column.
        reach = max(margin, 2.0 / counts[c])
        low, high = max(0.0, probs[i] - reach), min(1.0, probs[i] + reach)
        sketches.append(
            f"array(min({c}), max({c})) AS q_{k}" if reach >= 1
            else f"percentile_approx({c}, array({low!r}D, {high!r}D), 10000) AS q_{k}"
        )
    row = data.agg(*[F.expr(s) for s in sketches]).first()
    bands.update({key: _whole(*row[f"q_{k}"]) for k, key in enumerate(keys)})


def _whole(low, high):
    """The sketch works in doubles; for large integers, allow for their rounding."""
    if not isinstance(low, int):
        return low, high
    return low - int(math.ulp(float(low))), high + int(math.ulp(float(high)))


def _pick(data, keys, bands, ranks) -> dict:
    if not keys:
        return {}
    inside = ", ".join(
        f"IF({c} BETWEEN {_literal(bands[c, i][0])} AND {_literal(bands[c, i][1])}, struct({k} AS k, {c} AS value), NULL)"
        for k, (c, i) in enumerate(keys)
    )
    offsets = ", ".join(f"array({ranks[key][0]}L, {ranks[key][1]}L)" for key in keys)
    by_value = data.selectExpr(f"inline(array_compact(array({inside})))").groupBy("k", "value").agg(
        F.count("*").alias("n")
    )
    upto = F.sum("n").over(W.partitionBy("k").orderBy("value"))
    ranked = by_value.withColumn("upto", upto).withColumn("ranks", F.expr(f"get(array({offsets}), k)"))
    # At most two rows per column and quantile reach the driver.
    rows = ranked.where("exists(ranks, r -> r >= upto - n AND r < upto)").orderBy("k", "value").collect()
    values = {k: [r["value"] for r in rows if r["k"] == k] for k in range(len(keys))}
    return {key: (values[k][0], values[k][-1]) for k, key in enumerate(keys)}


# --- exact shares of a hashed order -----------------------------------------------

def few_groups(df: DataFrame, column: str, limit: int = 1000) -> None:
    """Refuse a grouping column whose per-group summaries would be too many to broadcast."""
    if df.select(column).distinct().limit(limit + 1).count() > limit:
        raise ValueError(f"{column} has more than {limit} values")


def hash_rank_cuts(
    df: DataFrame, key: str, salt: str, group: str | None, ranks, buckets: int = 1 << 18
) -> DataFrame:
    """Per group, the (draw, key) pairs that end given ranks of the hashed order.

    ``ranks(n)`` maps a group-size column to an array of one-based ranks. Bucket counts
    place every rank in one bucket of the hash range; only those buckets are sorted.
    Returns (grp, cuts), one row per group.
    """
    grp = F.col(group) if group else F.lit(0)
    draws = df.select(grp.alias("grp"), F.col(key).alias("key"), uniform([F.col(key)], salt).alias("draw"))
    draws = draws.withColumn("bucket", F.floor(F.col("draw") * buckets))
    # At most `buckets` rows per group from here to the join; groups are classes of a label.
    if group:
        few_groups(df, group)
    counts = draws.groupBy("grp", "bucket").agg(F.count("*").alias("n"))
    spread = W.partitionBy("grp")
    wanted = (
        counts.withColumn("upto", F.sum("n").over(spread.orderBy("bucket")))
        .withColumn("size", F.sum("n").over(spread))
        .withColumn("rank", F.explode(ranks(F.col("size"))))
        .where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
        .select("grp", "bucket", (F.col("rank") - F.col("upto") + F.col("n")).alias("local_rank"))
        .groupBy("grp", "bucket").agg(F.collect_list("local_rank").alias("local_ranks"))
    )
    inside = draws.join(F.broadcast(wanted), ["grp", "bucket"])
    order = W.partitionBy("grp", "bucket").orderBy("draw", "key")
    return (
        inside.withColumn("rn", F.row_number().over(order))
        .where(F.array_contains("local_ranks", F.col("rn").cast("bigint")))
        .groupBy("grp")
        .agg(F.array_sort(F.collect_list(F.struct("draw", "key"))).alias("cuts"))
    )


def cuts_passed(
    df: DataFrame, key: str, salt: str, group: str | None, ranks, name: str
) -> DataFrame:
    """Add ``name``: how many of the group's rank cuts lie before the row's own place.

    Zero means the row is among the first ``ranks[0]`` of its group. The cuts are one row
    per group, so the wide frame itself is never shuffled.
    """
    cuts = hash_rank_cuts(df, key, salt, group, ranks)
    grp = F.col(group) if group else F.lit(0)
    place = F.struct(uniform([F.col(key)], salt).alias("draw"), F.col(key).alias("key"))
    # The counter column makes no cut at all (a share of zero rows) count as passed.
    passed = F.size(F.filter("cuts", lambda cut: cut < place))
    return (
        df.withColumn("grp", grp)
        .join(F.broadcast(cuts), "grp", "left")
        .withColumn(name, F.when(F.col("cuts").isNull(), F.lit(1)).otherwise(passed))
        .drop("grp", "cuts")
    )


# --- running totals over a value order --------------------------------------------

def split_points(df: DataFrame, column: str, buckets: int) -> list[float]:
    """Approximate quantiles as literals, at most ``buckets - 1`` of them."""
    edges = [i / buckets for i in range(1, buckets)]
    values = df.agg(F.percentile_approx(column, edges, 1000)).first()[0] or []
    return sorted(set(values))


def bucket_of(value: Column, points: list[float], first: int = 0) -> Column:
    """How many points lie at or below the value, by binary search in plain comparisons."""
    if not points:
        return F.lit(first)
    middle = len(points) // 2
    return F.when(value < points[middle], bucket_of(value, points[:middle], first)).otherwise(
        bucket_of(value, points[middle + 1:], first + middle + 1)
    )
