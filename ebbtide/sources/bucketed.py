"""Tables stored in buckets of the user key, so that joins and roll-ups by user need no shuffle.

All tables that are to be joined have one bucket count, which is also the number of tasks of
the join. It belongs to the store, not to the session: choose it so that a bucket of the
largest table fits a task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ebbtide.sources.star import TABLES, Star, conform, make_star

KEY = "user_key"


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """``df`` as an external table at ``path``, in sorted buckets with one file each.

    The rows are dealt by the key before the write, else every task would write a file per bucket.
    """
    dealt = df.repartition(buckets, KEY)
    dealt.write.mode("overwrite").bucketBy(buckets, KEY).sortBy(KEY).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def store_star(star: Star, path: str, buckets: int, database: str = "default") -> dict[str, str]:
    """Write the three tables of ``star`` in buckets under ``path``; their names in the catalog."""
    names = {}
    for name, frame in zip(TABLES, (star.users, star.activity, star.engagement)):
        names[name] = f"{database}.{name}_{uuid.uuid4().hex[:12]}"
        write_bucketed(frame, names[name], f"{path}/{name}", buckets)
    return names


def bucketed_star(spark: SparkSession, names: dict[str, str]) -> Star:
    """The star of tables that ``store_star`` wrote."""
    return make_star(*[conform(spark.table(names[name]), schema) for name, schema in TABLES.items()])
