"""The user roll-up kept up to date by load days, without reading old facts again.

Each load is reduced to partial states: per user the sums, counts and maxima that all numbers
of the roll-up follow from. States of different loads are merged by sums and maxima, so a new
day costs a scan of its own rows, and a read costs the states alone. Merging many days into
one keeps their number small.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.operators.rollup import AVERAGES, MAXIMA, TOTALS, finish_rollup
from ebbtide.sources.files import Folder
from ebbtide.sources.star import ACTIVITY, ENGAGEMENT, conform

_MERGED = "merged"


def activity_state(activity: DataFrame) -> DataFrame:
    """One row per user of some activity rows."""
    return activity.groupBy("user_key").agg(
        F.sum("avg_session_duration").alias("duration_sum"), F.count("avg_session_duration").alias("duration_count"),
        F.max("last_activity_date").alias("last_active"), *[F.sum(source).alias(name) for name, source in TOTALS.items()],
    )


def engagement_state(engagement: DataFrame) -> DataFrame:
    return engagement.groupBy("user_key").agg(
        F.count("*").alias("engagement_rows"),
        *[F.sum(source).alias(f"{name}_sum") for name, source in AVERAGES.items()],
        *[F.count(source).alias(f"{name}_count") for name, source in AVERAGES.items()],
        *[F.max(name).alias(name) for name in MAXIMA],
    )


def merge_states(states: DataFrame) -> DataFrame:
    """One row per user: maxima of the maxima, sums of everything else."""
    largest = {"last_active", *MAXIMA}
    return states.groupBy("user_key").agg(*[
        (F.max if c in largest else F.sum)(c).alias(c) for c in states.columns if c != "user_key"
    ])


class RollupStore:
    """Partial states in ``<path>/<fact>/<load>``, a load being a day or what earlier days were merged into.

    A load is written under a draft name and renamed. A day that is loaded again replaces
    its earlier state until it has been merged; afterwards it is refused.
    """

    FACTS = {"activity": (activity_state, ACTIVITY), "engagement": (engagement_state, ENGAGEMENT)}

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.folder = spark, Folder(spark, path)

    def loads(self, fact: str) -> list[str]:
        """Finished loads of a fact in order: merged ones first, then days."""
        names = [n for n in self.folder.names(fact) if not n.startswith("draft-")]
        return sorted(names, key=lambda n: (not n.startswith(_MERGED), n))

    def _write(self, fact: str, name: str, state: DataFrame) -> None:
        draft = f"{fact}/draft-{uuid.uuid4().hex}"
        state.write.parquet(f"{self.folder.path}/{draft}")
        if not self.folder.rename(draft, f"{fact}/{name}"):
            self.folder.delete(f"{fact}/{name}")
            self.folder.rename(draft, f"{fact}/{name}")

    def merged_until(self, fact: str) -> str:
        """The last day that is part of a merged load; empty if there is none."""
        return max((n.removeprefix(f"{_MERGED}-") for n in self.loads(fact) if n.startswith(_MERGED)), default="")

    def append(self, day: date, **facts: DataFrame) -> None:
        """Add the rows that were loaded on ``day``: ``activity=``, ``engagement=`` or both."""
        for fact, rows in facts.items():
            reduce, schema = self.FACTS[fact]
            if day.isoformat() <= self.merged_until(fact):
                raise ValueError(f"{fact} of {day} has been merged already")
            self._write(fact, day.isoformat(), reduce(conform(rows, schema)))

    def merge(self, until: date) -> None:
        """Turn all loads up to ``until`` into one. Readers see the old ones or the merged one."""
        for fact in self.FACTS:
            old = [n for n in self.current(fact) if n.removeprefix(f"{_MERGED}-") <= until.isoformat()]
            if old:
                self._write(fact, f"{_MERGED}-{until.isoformat()}", merge_states(self._read(fact, old)))
                for name in old:
                    self.folder.delete(f"{fact}/{name}")

    def current(self, fact: str) -> list[str]:
        """The loads to read: the newest merged one and the days after it. What a merge has
        taken in and not yet deleted is left out."""
        last = self.merged_until(fact)
        days = [n for n in self.loads(fact) if not n.startswith(_MERGED) and n > last]
        return [f"{_MERGED}-{last}", *days] if last else days

    def _read(self, fact: str, names: list[str]) -> DataFrame:
        reduce, schema = self.FACTS[fact]
        empty = reduce(self.spark.createDataFrame([], schema))
        return self.spark.read.schema(empty.schema).parquet(*[f"{self.folder.path}/{fact}/{n}" for n in names]) if names else empty

    def rollup(self, users: DataFrame, fanout: str = "compat") -> DataFrame:
        """The roll-up of all loads; equal to ``user_rollup`` over all facts."""
        activity, engagement = (merge_states(self._read(fact, self.current(fact))) for fact in self.FACTS)
        activity = activity.withColumn("avg_session_duration", F.try_divide("duration_sum", "duration_count"))
        for name in AVERAGES:
            engagement = engagement.withColumn(name, F.try_divide(f"{name}_sum", f"{name}_count"))
        return finish_rollup(users, activity, engagement, fanout)
