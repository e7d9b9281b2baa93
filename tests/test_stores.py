"""Incremental roll-up and tables in buckets."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ebbtide.operators.rollup import user_rollup
from ebbtide.operators.series import daily_series
from ebbtide.plans.queries import SETTINGS, Inputs
from ebbtide.sources.bucketed import bucketed_star, store_star, write_bucketed
from ebbtide.sources.files import Folder
from ebbtide.sources.increments import RollupStore
from ebbtide.sources.star import ACTIVITY, ENGAGEMENT, USERS, Star

DAYS = [date(2024, 1, d) for d in range(1, 5)]


@pytest.fixture(scope="module")
def star(spark):
    def facts(schema, n, salt):
        def value(f):
            kind = f.dataType.simpleString()
            draw = F.pmod(F.xxhash64("id", F.lit(f.name + salt)), F.lit(90))
            if f.name == "user_key":
                return (draw % 17).cast(kind).alias(f.name)
            if kind == "date":
                return F.date_add(F.lit("2024-01-01").cast("date"), (draw % 4).cast("int")).alias(f.name)
            return F.when(draw % 7 > 0, draw).cast(kind).alias(f.name)

        return spark.range(n).select(*[value(f) for f in schema])

    users = spark.range(25).select(*[
        F.col("id").alias("user_key") if f.name == "user_key" else
        F.when(F.col("id") % 5 == 4, "deleted").otherwise("active").alias(f.name) if f.name == "account_status" else
        F.lit(None).cast(f.dataType).alias(f.name) for f in USERS
    ])
    return Star(users, facts(ACTIVITY, 300, "a").cache(), facts(ENGAGEMENT, 60, "e").cache())


def rows(df):
    return sorted(map(str, df.select([F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes]).collect()))


def load(spark, star, day, folder):
    """The rows of a load, from files of their own."""
    index = DAYS.index(day)
    star.activity.where(F.col("last_activity_date") == F.lit(day)).write.parquet(f"{folder}/activity-{day}")
    star.engagement.where(F.pmod(F.xxhash64(*star.engagement.columns), F.lit(4)) == index).write.parquet(f"{folder}/engagement-{day}")
    return {fact: spark.read.parquet(f"{folder}/{fact}-{day}") for fact in ("activity", "engagement")}


@pytest.mark.parametrize("fanout", ["compat", "corrected"])
def test_loads_add_up_and_old_facts_are_not_read(spark, star, tmp_path, fanout):
    store, files = RollupStore(spark, str(tmp_path / "store")), Folder(spark, str(tmp_path / "facts"))
    assert rows(store.rollup(star.users, fanout)) == rows(user_rollup(Star(star.users, star.activity.limit(0), star.engagement.limit(0)), fanout))
    for day in DAYS:
        store.append(day, **load(spark, star, day, tmp_path / "facts"))
        # Whatever reads facts of an earlier day again fails from here on.
        files.delete()
        if day == DAYS[1]:
            store.append(day, **load(spark, star, day, tmp_path / "facts"))  # loaded again: no double count
        if day == DAYS[2]:
            store.merge(DAYS[1])
            assert store.loads("activity") == [f"merged-{DAYS[1]}", str(DAYS[2])]
            with pytest.raises(ValueError, match="merged"):
                store.append(DAYS[0], activity=star.activity)
    assert rows(store.rollup(star.users, fanout)) == rows(user_rollup(star, fanout))
    store.merge(DAYS[3])
    assert store.current("engagement") == [f"merged-{DAYS[3]}"]
    assert rows(store.rollup(star.users, fanout)) == rows(user_rollup(star, fanout))


def test_a_merge_or_load_that_died_changes_nothing(spark, star, tmp_path, monkeypatch):
    store = RollupStore(spark, str(tmp_path / "store"))
    for day in DAYS[:3]:
        store.append(day, **load(spark, star, day, tmp_path / "facts"))
    before = rows(store.rollup(star.users))
    for action in ("rename", "delete"):
        monkeypatch.setattr(Folder, action, lambda *_: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            store.merge(DAYS[2])
        monkeypatch.undo()
        assert rows(store.rollup(star.users)) == before
    # The second merge had its result in place and died while deleting what went into it.
    assert store.current("activity") == [f"merged-{DAYS[2]}"] and len(store.loads("activity")) == 4


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_by_user_need_no_exchange(spark, star, tmp_path):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        stored = user_rollup(bucketed_star(spark, store_star(star, str(tmp_path / "star"), 5)))
        assert "Exchange" not in plan(stored) and plan(stored).count("SortMergeJoin") == 2
        assert rows(stored) == rows(user_rollup(star)) and "Exchange" in plan(user_rollup(star))
        given = Inputs(spark, "/root/testdata/sf0.001")
        daily = write_bucketed(given.daily, "daily_in_buckets", str(tmp_path / "daily"), 5)
        users = write_bucketed(given.star.users, "users_in_buckets", str(tmp_path / "users"), 5)
        series = daily_series(daily, users, SETTINGS.as_of)
        assert "Exchange" not in plan(series) and "SortMergeJoin" in plan(series)
        assert rows(series) == rows(daily_series(given.daily, given.star.users, SETTINGS.as_of))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
