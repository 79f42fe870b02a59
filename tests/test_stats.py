import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverbed.operators import stats
from riverbed.operators.curves import curve_measures
from riverbed.operators.matching import improve, matched, spaced, stratified_order


def sample(n=200, seed=2):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "a", "a", "b"]), rng.choice([None, *range(20)]), rng.gauss(0, 3)) for i in range(n)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(sample(), "i int, k string, x int, y double").cache()


def test_ranks_and_percentiles(df):
    got = {(r.k, r.x): r.rank for r in stats.average_ranks(df, "k", "x").collect()}
    pct = {(r.k, r.x): r.percentile for r in stats.percentile_of_value(df, "k", "x").collect()}
    for k in "ab":
        xs = sorted(r[2] for r in sample() if r[1] == k and r[2] is not None)
        for x in set(xs):
            places = [i + 1 for i, v in enumerate(xs) if v == x]
            assert got[k, x] == sum(places) / len(places)
            assert pct[k, x] == pytest.approx((places[-1] - 1) / (len(xs) - 1))
    q = {r.k: (r.q0, r.q1) for r in stats.interpolated_percentiles(df, "k", "y", [0.25, 0.9]).collect()}
    for k in "ab":
        assert q[k] == pytest.approx(tuple(np.percentile([r[3] for r in sample() if r[1] == k], [25, 90])))


def test_correlations(spark, df):
    got = {r.k: r.rho for r in stats.spearman(df, "k", "x", "y").collect()}
    for k in "ab":
        xs, ys = zip(*[(r[2], r[3]) for r in sample() if r[1] == k and r[2] is not None])
        rank = lambda v: [(sum(a < b for a in v) + sum(a <= b for a in v) + 1) / 2 for b in v]
        assert got[k] == pytest.approx(np.corrcoef(rank(xs), rank(ys))[0, 1])
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert flat.agg(stats.pearson(F.col("a"), F.col("b"))).first()[0] == 0.0
    assert flat.agg(stats.pearson(F.col("a"), F.col("b"), None)).first()[0] is None


def test_concentration(spark):
    r = stats.concentration(spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, -4.0, None)] + [("z", 0.0)], "k string, v double"), "k", "v").orderBy("k").collect()
    assert (r[0].n, r[0].hhi, r[0].effective) == (3, pytest.approx(14 / 36), pytest.approx(36 / 14)) and r[0].gini == pytest.approx(2 * 14 / 18 - 4 / 3)
    assert (r[1].hhi, r[1].effective, r[1].gini) == (0.0, 0.0, 0.0)


def test_smd_edges(spark):
    d = spark.createDataFrame([(1.0, True), (1.0, True), (2.0, False), (2.0, False)], "v double, t boolean")
    assert d.agg(stats.smd(F.col("v"), F.col("t"))).first()[0] == 0.0
    assert d.agg(stats.smd(F.col("v"), F.col("t"), "nan_inf")).first()[0] == math.inf
    assert math.isnan(d.limit(1).agg(stats.smd(F.col("v"), F.col("t"), "nan_inf")).first()[0])


def test_holm_never_shrinks(spark):
    d = spark.createDataFrame([("f", str(i), p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5, 0.9])], "f string, n string, p double")
    got = {r.p: r.p_holm for r in stats.holm(d, ["f"], "p", ["n"]).collect()}
    assert got == {0.01: pytest.approx(0.05), 0.03: pytest.approx(0.12), 0.04: pytest.approx(0.12), 0.5: pytest.approx(1.0), 0.9: pytest.approx(1.0)}
    assert all(v >= k for k, v in got.items())


def test_wilcoxon(spark):
    v = [1.0, -2.0, 3.0, 3.0, -3.0, 0.0, 5.0, 6.0, None]
    r = stats.wilcoxon(spark.createDataFrame([("a", x) for x in v], "k string, v double"), "k", "v").first()
    assert (r.n, r.w_plus) == (7, 1 + 4 + 4 + 6 + 7)
    var = 7 * 8 * 15 / 24 - (27 - 3) / 48
    assert r.z == pytest.approx((22 - 14 - 0.5) / math.sqrt(var)) and r.p == pytest.approx(math.erfc(r.z / math.sqrt(2)))


def test_resampling_covers_and_repeats(spark):
    rng = np.random.default_rng(1)
    rows = [("up", i, float(x)) for i, x in enumerate(rng.normal(1.0, 1.0, 300))] + [("none", i, float(x)) for i, x in enumerate(rng.normal(0.0, 1.0, 300))]
    d = spark.createDataFrame(rows, "k string, i int, v double")
    b = {r.k: r for r in stats.bootstrap_mean(d, "k", "v", 200).collect()}
    again = {r.k: r for r in stats.bootstrap_mean(d.repartition(3), "k", "v", 200).collect()}
    assert b["up"].low < b["up"].mean < b["up"].high and b["up"].high - b["up"].low == pytest.approx(4 / math.sqrt(300), rel=0.3)
    assert again["up"].low == pytest.approx(b["up"].low)
    p = {r.k: r.p for r in stats.sign_flip(d, "k", "v", 200).collect()}
    assert p["up"] == pytest.approx(1 / 201) and p["none"] > 0.01


def test_curves(spark):
    d = spark.createDataFrame([("c", 10.0, 20.0), ("c", 30.0, 40.0), ("c", None, 1.0), ("z", 0.0, 0.0)], "k string, x double, y double")
    r = {x.k: x for x in curve_measures(d, ["k"], "x", "y", [0.0, 10.0, 30.0, 100.0]).collect()}
    assert r["c"].area == pytest.approx((100 + 600) / 30) and (r["c"].depth_10, r["c"].depth_30) == (5.0, 20.0)
    assert (r["c"].depth_100, r["c"].breached_100) == (30.0, False) and r["c"].breached_0 and r["z"].area == 0.0


def test_stratified_order_covers_bins_first(spark):
    d = spark.createDataFrame([("p", b, 0) for b in (100, 101, 102, 126, 127, 151, 152, 176, 177, 199)], "k string, b long, l int")
    got = stratified_order(d, "k", "b", F.col("b").cast("string"), ["b", "l"], 4, 20260725).orderBy("place").collect()
    assert {r.bin for r in got[:4]} == {0, 1, 2, 3} and [r.place for r in got] == list(range(10))


def test_spaced(spark):
    d = spark.createDataFrame([("p", b) for b in (1, 5, 10, 11, 30, 30, None)] + [(None, 3)], "k string, b long")
    assert sorted(r.b for r in spaced(d, "k", "b", 10).collect()) == [1, 11, 30]
    assert spaced(d.where("false"), "k", "b", 10).count() == 0


def test_spaced_chains_run_through_chunks(spark):
    rng = random.Random(3)
    rows = [("hot", rng.randrange(-500, 4000)) for _ in range(900)] + [("far", b) for b in (0, 9, 700, 1400, 1409, 9000)]
    got = {}
    for r in spaced(spark.createDataFrame(rows, "k string, b long"), "k", "b", 10, cells=3).collect():
        got.setdefault(r.k, []).append(r.b)
    for k in ("hot", "far"):
        want, at = [], None
        for b in sorted({b for q, b in rows if q == k}):
            if at is None or b >= at + 10:
                want.append(b)
                at = b
        assert sorted(got[k]) == want


def test_matching_is_one_to_one_and_swaps_help(spark):
    rng = random.Random(4)
    rows = [("k", i, i % 3 == 0, rng.random(), rng.random() if i % 7 else None) for i in range(90)]
    d = spark.createDataFrame(rows, "k string, i int, t boolean, x double, y double")
    got = matched(d, ["k"], "i", "t", ["x", "y"], 1.25).collect()
    assert got and len({r.control for r in got}) == len(got) == len({r.i for r in got})
    assert all(int(r.i) % 3 == 0 and int(r.control) % 3 and r.distance <= 1.25 for r in got)
    cost = np.random.default_rng(0).random((6, 6))
    start = np.arange(6)
    assert cost[start, improve(cost, start)].sum() <= cost[start, start].sum()


def test_controls_are_shared_up_to_a_limit(spark):
    from collections import Counter

    from riverbed.operators.matching import controls

    rng = random.Random(7)
    rows = [("k", i, i % 2 == 0, rng.random(), None) for i in range(80)]
    got = controls(spark.createDataFrame(rows, "k string, i int, t boolean, x double, y double"), ["k"], "i", "t", ["x", "y"], 0.5, per=3, reuse=2).collect()
    assert max(Counter(r.control for r in got).values()) <= 2 and max(Counter(r.i for r in got).values()) <= 3
    assert all(int(r.i) % 2 == 0 and int(r.control) % 2 and r.distance <= 0.5 for r in got)
    one = spark.createDataFrame(rows[:1], "k string, i int, t boolean, x double, y double")
    assert controls(one, ["k"], "i", "t", ["x"], 1.0).count() == 0
