"""Resampling: the reference's number of replicates, and sums of keys that lie over several partitions."""

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverbed.operators import stats
from riverbed.plans.statistics import mean_intervals


def test_intervals_of_twenty_thousand_replicates(spark, tmp_path):
    schema = """impact_id long, snapshot_index long, pool_address string, block_number long, current_tick int, position_key string, tick_lower int, tick_upper int, position_liquidity string,
      active_liquidity_share double, range_width int, distance_to_lower_tick int, distance_to_upper_tick int, distance_to_nearest_edge int, zero_for_one_lsis_bps decimal(38,18), one_for_zero_lsis_bps decimal(38,18), total_lsis_bps decimal(38,18)"""
    rows = [(i, i, "0x" + "ab" * 20, i, 0, "k", -10, 10, "5", 0.1, 20, 10, 10, 10, Decimal(3 + i % 2), Decimal(1), Decimal(4)) for i in range(60)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/position_impacts.parquet")
    (r,) = mean_intervals(spark, str(tmp_path)).collect()
    assert (r.n, r.mean, r.p) == (60, 2.5, 1 / 20_001)
    assert r.low == pytest.approx(2.5 - 1.96 * 0.5 / 60**0.5, abs=0.02) and r.high == pytest.approx(2.5 + 1.96 * 0.5 / 60**0.5, abs=0.02)


def test_replicates_equal_sums_over_all_rows(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", "b", "c", None]), rng.gauss(0.2, 1)) for i in range(400)] + [(400, "one", 3.0)]
    d = spark.createDataFrame(rows, "i long, k string, v double").repartition(3)
    seeds = {r.i: r for r in d.select("i", *[F.xxhash64("i", "k", "v", F.lit(x)).alias(f"h{x}") for x in (1, 2)]).collect()}
    b, f = ({r.k: r for r in q(d, "k", "v", 300).collect()} for q in (stats.bootstrap_mean, stats.sign_flip))
    weights = lambda draw, h: draw(np.random.Generator(np.random.SFC64(h & 0xFFFFFFFFFFFFFFFF)), 300).astype(float)
    assert set(b) == set(f) == {"hot", "a", "b", "c", "one", None}
    for k in b:
        own = [(i, v) for i, x, v in rows if x == k]
        w = np.array([weights(stats._poisson, seeds[i].h1) for i, _ in own])
        v = np.array([v for _, v in own])
        some = w.sum(axis=0) > 0
        m = np.sort((v @ w)[some] / w.sum(axis=0)[some])
        assert (b[k].n, b[k].mean) == (len(own), pytest.approx(v.mean()))
        assert (b[k].low, b[k].high) == (pytest.approx(m[7]), pytest.approx(m[min(292, len(m) - 1)]))
        s = v @ np.array([weights(stats._signs, seeds[i].h2) for i, _ in own])
        assert f[k].p == pytest.approx((np.count_nonzero(np.abs(s) >= abs(v.sum()) * (1 - 1e-9)) + 1) / 301)


def test_poisson_weights():
    w = stats._poisson(np.random.Generator(np.random.SFC64(1)), 1_000_000)
    assert np.bincount(w)[:4] / 1e6 == pytest.approx([0.36788, 0.36788, 0.18394, 0.06131], abs=0.002)
    assert w.mean() == pytest.approx(1, abs=0.004) and w.var() == pytest.approx(1, abs=0.006)
