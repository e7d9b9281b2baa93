"""Train/test splits and folds that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.draws import uniform
from ebbtide.operators.order_stats import cuts_passed, value_at_share

#: Size of a key sketch; a state takes a few KB whatever the number of its rows.
SKETCH_K = 800


def mark_test(
    df: DataFrame, label: str, share: float, seed: int, key: str = "user_key", mode: str = "exact"
) -> DataFrame:
    """Add ``is_test``: the share of each class, rounded to whole rows, in hashed order.

    ``approx`` decides each row by its own draw, which needs no counting.
    """
    salt = f"split:{seed}"
    if mode == "approx":
        return df.withColumn("is_test", uniform([F.col(key)], salt) < share)
    marked = cuts_passed(
        df, key, salt, label, lambda n: F.array(F.floor(n * F.lit(share) + 0.5)), "cuts_before"
    )
    return marked.withColumn("is_test", F.col("cuts_before") == 0).drop("cuts_before")


def stratified_split(
    df: DataFrame, label: str = "churned", share: float = 0.2, seed: int = 42, mode: str = "exact"
) -> tuple[DataFrame, DataFrame]:
    marked = mark_test(df, label, share, seed, mode=mode)
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")


def sample_users(df: DataFrame, n: int = 50, seed: int = 42, key: str = "user_key") -> DataFrame:
    """A random sample of at most ``n`` rows, in hashed order of the key."""
    return df.orderBy(uniform([F.col(key)], f"sample:{seed}"), key).limit(n)


def ordered_split(df: DataFrame, share: float = 0.8, key: str = "user_key") -> tuple[DataFrame, DataFrame]:
    """The first ``max(1, int(share * n))`` keys in order, and the rest."""
    cut = value_at_share(df, key, share)
    return df.where(F.col(key) <= F.lit(cut)), df.where(F.col(key) > F.lit(cut))


def rank_bound(k: int = SKETCH_K) -> float:
    """How far the rank of a cut may be off, as a share of all rows, in 99 of 100 sketches of size ``k``."""
    return 2.296 / k**0.9723


def key_states(df: DataFrame, by: str, key: str = "user_key", k: int = SKETCH_K) -> DataFrame:
    """(by, state): a quantile sketch of the keys of each group, for example of each load day.

    States of new groups are made from their own rows and appended; null keys are left out.
    """
    return df.groupBy(by).agg(F.kll_sketch_agg_bigint(F.col(key), F.lit(k)).alias("state"))


def state_cut(states: DataFrame, share: float = 0.8) -> int | None:
    """The key at the share of all rows whose states these are; None without rows. Reads no rows but the states."""
    whole = states.agg(F.kll_merge_agg_bigint("state").alias("whole"))
    rows = F.kll_sketch_get_n_bigint("whole")
    return whole.select(F.when(rows > 0, F.kll_sketch_get_quantile_bigint("whole", F.lit(share)))).first()[0]


def state_split(
    df: DataFrame, states: DataFrame, share: float = 0.8, key: str = "user_key"
) -> tuple[DataFrame, DataFrame]:
    """``ordered_split`` at the cut that stored states give: no pass over ``df`` before the two filters."""
    cut = F.lit(state_cut(states, share)).cast("bigint")
    return df.where(F.col(key) <= cut), df.where(F.col(key) > cut)


def cut_error(df: DataFrame, cut: int | None, share: float = 0.8, key: str = "user_key") -> DataFrame:
    """One row (n_rows, rank_error): how far ``share`` lies outside the ranks that rows of the key ``cut`` take.

    Repeated keys take a range of ranks, so a cut at a very frequent key is exact if the range holds the share.
    Null keys do not count; an empty table has an error of 0.
    """
    own = df.where(F.col(key).isNotNull()).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col(key) < F.lit(cut)).alias("below"), F.count_if(F.col(key) <= F.lit(cut)).alias("upto")
    )
    error = F.greatest(F.lit(0.0), F.col("below") / F.col("n_rows") - share, share - F.col("upto") / F.col("n_rows"))
    return own.select("n_rows", F.when(F.col("n_rows") > 0, error).otherwise(0.0).alias("rank_error"))


def split_series(
    series: DataFrame, users: DataFrame, share: float = 0.8, key: str = "user_key"
) -> tuple[DataFrame, DataFrame]:
    """The series of the first ``max(1, int(share * n))`` users in order, and of the rest.

    The cut is made over ``users``, one row per user, so the days of a series do not count.
    """
    cut = value_at_share(users, key, share)
    return series.where(F.col(key) <= F.lit(cut)), series.where(F.col(key) > F.lit(cut))


def stratified_folds(
    df: DataFrame, label: str = "churned", folds: int = 5, seed: int = 42, key: str = "user_key"
) -> DataFrame:
    """Add ``fold`` (0-based): equal contiguous runs of each class in hashed order."""
    def ends(n):
        return F.transform(
            F.sequence(F.lit(1), F.lit(folds - 1)),
            lambda i: i * F.floor(n / folds) + F.least(i.cast("bigint"), n % folds),
        )

    marked = cuts_passed(df, key, f"fold:{seed}", label, ends, "fold")
    return marked.withColumn("fold", F.col("fold").cast("int"))
