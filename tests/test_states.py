"""Mergeable states and the end of what a run has written."""

import os
import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import forecaster, split
from ebbtide.operators.curves import curve_areas, histogram_area, score_histogram, threshold_totals
from ebbtide.operators.distinct import count_distinct, distinct_state, merge_distinct
from ebbtide.operators.series import METRICS
from ebbtide.session import durable, run_scope, shared_folder
from ebbtide.settings import Settings


def test_bitmaps_count_distinct_ids(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.choice([None, 0, 1, 32_767, 32_768, 10**12, rng.randint(0, 200_000)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "part string, user_key long")
    states = distinct_state(df, ["part"])
    want = {p: len({k for q, k in rows if q == p and k is not None}) for p in "abc"}
    assert {r.part: r.users for r in count_distinct(states, ["part"]).collect()} == want
    both = merge_distinct(states.union(distinct_state(df, ["part"])), [F.lit("all").alias("part")])
    assert count_distinct(both, ["part"]).first().users == len({k for _, k in rows if k is not None})
    assert count_distinct(distinct_state(df.limit(0), ["part"]), ["part"]).count() == 0


@pytest.mark.parametrize("bins", [1, 7, 1000])
def test_exact_area_is_within_the_bound(spark, bins):
    rng = random.Random(bins)
    rows = [(k, int(rng.random() < 0.3), rng.choice([0.0, 1.0, 0.5, rng.random()])) for k in range(2000)]
    df = spark.createDataFrame([(k, c, min(1.0, s * (1 + c) / 2 + 0.1)) for k, c, s in rows], "user_key long, churned int, score double")
    found, exact = histogram_area(score_histogram(df, bins)).first(), curve_areas(threshold_totals(df)).first().roc_auc
    assert abs(found.area - exact) <= found.error + 1e-12 and (bins > 1 or found.area == found.error == 0.5)
    assert bins < 1000 or found.error < 0.15
    assert histogram_area(score_histogram(df.where("churned = 1"), bins)).first().area is None


def test_a_run_leaves_no_file(spark):
    root = shared_folder(spark)
    before = sorted(os.listdir(root)) if os.path.isdir(root) else []
    with run_scope(spark) as path:
        kept = durable(spark.range(10))
        with run_scope(spark):
            durable(spark.range(5))
        assert durable(kept.where("id > 3")).count() == 6 and os.path.isdir(path.removeprefix("file:"))
    with pytest.raises(RuntimeError):
        with run_scope(spark):
            durable(spark.range(3))
            raise RuntimeError
    assert sorted(os.listdir(root)) == before


def test_cuts_from_merged_states_stay_within_their_bound(spark):
    rng = np.random.default_rng(4)
    keys = np.where(rng.random(60_000) < 1 / 3, 700_000, rng.integers(0, 1_000_000, 60_000))
    rows = spark.createDataFrame([(int(k), i % 7) for i, k in enumerate(keys)] + [(None, 3)], "user_key bigint, load int")
    states = split.key_states(rows, "load")
    for share in (0.1, 0.5, 0.6, 0.8, 0.95):
        cut = split.state_cut(states, share)
        row = split.cut_error(rows, cut, share).first()
        below, upto = (keys < cut).mean(), (keys <= cut).mean()
        assert row.n_rows == 60_000
        assert abs(row.rank_error - max(0, below - share, share - upto)) < 1e-12
        # Single sketches exceed the bound once in a hundred times; twice the bound practically never.
        assert row.rank_error <= 2 * split.rank_bound()
    assert split.state_cut(states, 0.6) == 700_000
    first, rest = split.state_split(rows, states.where("load < 7"))
    assert first.count() + rest.count() == 60_000


def test_states_of_no_rows_cut_nothing(spark):
    none = spark.createDataFrame([], "user_key bigint, load int")
    states = split.key_states(none, "load")
    assert split.state_cut(states) is None
    assert [part.count() for part in split.state_split(none, states)] == [0, 0]
    assert tuple(split.cut_error(none, None).first()) == (0, 0.0)


def test_training_rows_in_few_partitions_under_one_mark(spark, monkeypatch):
    seen = {}

    def fit(self, names, make, parallelism):
        seen["folder"] = self.folder.path
        make(names[0])
        raise StopIteration

    class Probe:
        def fit(self, data):
            seen["partitions"] = len(data.groupBy(F.spark_partition_id()).count().collect())

    monkeypatch.setattr(forecaster.FitLedger, "fit", fit)
    monkeypatch.setattr(forecaster, "_regressor", lambda *_: Probe())
    settings = Settings(as_of=date(2024, 1, 31))
    marks = []
    for nudge in (0.0, -1e-13, 1e-6):
        values = [(F.lit(nudge) + F.pmod("user_key", F.lit(k + 2))).alias(m) for k, m in enumerate(METRICS)]
        series = spark.range(12_000).selectExpr("id AS user_key", "explode(sequence(-30, -1)) AS day_offset").select("user_key", "day_offset", *values)
        with pytest.raises(StopIteration):
            forecaster.fit_forecaster(series, settings)
        marks.append(seen["folder"])
    assert seen["partitions"] == 1
    assert marks[0] == marks[1] != marks[2]
