import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverbed.llm.nearest import XFastTries, nearest_times
from riverbed.llm.percentiles import exact_percentiles, interval_counts, merge_counts, percentiles_of_counts, value_counts
from riverbed.llm.topn import parts_of, top_n


def nearest(times, t, tolerance):
    best = min(((abs(x - t), x) for x in times), default=None)
    return best[1] if best and best[0] <= tolerance else None


@pytest.mark.parametrize("tolerance", [1, 7, 300])
def test_nearest_equals_brute_force(spark, tolerance):
    rng = random.Random(tolerance)
    left = [(i, rng.choice(["hot", "hot", "hot", "b", "c", None]), rng.choice([None, *range(-900, 900)]), "nearest") for i in range(400)]
    right = [(rng.choice(["hot", "b", None]), rng.choice([None, *range(-1000, 1000)]), i) for i in range(60)]
    a, b = spark.createDataFrame(left, "i int, k string, t long, nearest string"), spark.createDataFrame(right, "p string, at long, t int")
    got = nearest_times(a, b, tolerance, key="k", time="t", right_key="p", right_time="at").collect()
    assert len(got) == len(left)
    for r in got:
        known = [x for p, x, _ in right if p == r.k and x is not None] if r.k is not None else []
        assert r.nearest == (nearest(known, r.t, tolerance) if r.t is not None else None)


def test_nearest_ties_go_back_and_copies_stay(spark):
    a = spark.createDataFrame([("k", 10), ("k", 10), ("k", 20)], "k string, t long")
    b = spark.createDataFrame([("k", 5), ("k", 15), ("k", 15), ("k", 20)], "k string, t long")
    assert sorted((r.t, r.m) for r in nearest_times(a, b, 5, key="k", time="t", out="m").collect()) == [(10, 5), (10, 5), (20, 20)]
    none = spark.createDataFrame([], "k string, t long")
    assert nearest_times(none, b, 5, key="k", time="t").count() == 0
    assert [r.nearest for r in nearest_times(a, none, 5, key="k", time="t").collect()] == [None] * 3


def test_tries_find_neighbours_of_any_key():
    rng = np.random.default_rng(0)
    leaves = np.unique(np.r_[rng.integers(0, 64, 20), rng.integers(64, 128, 3), 5 * 64 + 9])
    ask = np.arange(6 * 64)
    before, after = XFastTries(leaves, 6).around(ask)
    for q in ask:
        own = [x for x in leaves if x >> 6 == q >> 6]
        assert (leaves[before[q]] if before[q] >= 0 else None) == max((x for x in own if x <= q), default=None)
        assert (leaves[after[q]] if after[q] >= 0 else None) == min((x for x in own if x >= q), default=None)


def rank_value(values, p):
    return sorted(values)[max(1, -(-len(values) * p // 1000)) - 1]


def test_percentiles_are_exact(spark):
    rng = random.Random(1)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1e300, -1e300, 5e-324]
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.choice([rng.gauss(0, 1), rng.expovariate(1e-6), 7.0, *odd])) for _ in range(900)] + [("only", 3.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("lo", F.lit("clash")).withColumn("o", F.lit(1))
    got = {r.g: r for r in exact_percentiles(df, ["g"], "v", [1, 500, 990, 1000]).collect()}
    for g in {r[0] for r in rows}:
        v = [x for k, x in rows if k == g and x is not None and abs(x) < float("inf")]
        if not v:
            assert g not in got
            continue
        assert got[g].row_count == len(v)
        assert [got[g][f"p{p}"] for p in (1, 500, 990, 1000)] == [rank_value(v, p) for p in (1, 500, 990, 1000)]
    assert exact_percentiles(df.where("false"), ["g"], "v", [500]).count() == 0


def test_percentiles_of_decimals_beyond_doubles(spark):
    from decimal import Decimal

    v = [Decimal("1000.000000000000000001") + Decimal(i) / 10**18 for i in range(99)]
    df = spark.createDataFrame([(x,) for x in v], "v decimal(38,18)")
    assert exact_percentiles(df, [], "v", [500, 900]).first()[1:] == (v[49], v[89])


def test_percentiles_in_passes_and_of_states(spark, monkeypatch):
    from riverbed.llm import percentiles

    monkeypatch.setattr(percentiles, "MANY", 8)
    rng = random.Random(4)
    rows = [("hot", rng.randrange(7), 100 + rng.random() * 0.1) for _ in range(3000)] + [(rng.choice("ab"), rng.randrange(7), rng.choice([-1, 1]) * rng.choice([5.0, rng.random()])) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, day int, v double")
    want = {g: tuple(rank_value([v for k, _, v in rows if k == g], p) for p in (10, 500, 990)) for g in ("hot", "a", "b")}
    assert {r.g: tuple(r)[2:] for r in exact_percentiles(df, ["g"], "v", [10, 500, 990]).collect()} == want
    days = value_counts(df, ["g", "day"], "v")
    assert {r.g: tuple(r)[2:] for r in exact_percentiles(days, ["g"], "v", [10, 500, 990], weight="rows").collect()} == want


def test_parts_of_order_like_the_decimal(spark):
    from decimal import Decimal

    v = [Decimal(x) for x in ("99999999999999999999.5", "99999999999999999999.500000000000000001", "-99999999999999999999.999999999999999999", "0", "-0.000000000000000001", "0.000000000000000001", "9999999999.999", "10000000000", "-1", "1")]
    for down in (False, True):
        got = spark.createDataFrame([(x,) for x in v], "v decimal(38,18)").select("v", *parts_of(F.col("v"), down)).collect()
        assert [r.v for r in sorted(got, key=lambda r: (r.part0, r.part1, r.part2))] == sorted(v, reverse=down)


def test_states_of_days_combine_to_bounds(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(5), rng.choice([-1, 1]) * rng.expovariate(0.01)) for _ in range(1000)]
    df = spark.createDataFrame(rows, "g string, day int, v double")
    days = [interval_counts(df.where(F.col("day") == d), ["g"], "v") for d in range(5)]
    state = days[0]
    for d in days[1:]:
        state = state.unionByName(d)
    for r in percentiles_of_counts(merge_counts(state, ["g"]), ["g"], [10, 500, 990]).collect():
        exact = rank_value([v for g, _, v in rows if g == r.g], r.permille)
        assert r.at_least <= exact <= r.at_most and r.at_most - r.at_least <= abs(exact) / 256 * 1.01


def test_top_n_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None, f"k{i}"]), rng.choice([None, *range(6)]), i, "x") for i in range(600)]
    df = spark.createDataFrame(rows, "k string, s long, i long, place string").drop("place").withColumn("o0", F.lit("clash"))
    got = sorted((r.k, r.place, r.i) for r in top_n(df.repartition(6), "k", ["s", "i"], 3).collect())
    want = []
    for k in {r[0] for r in rows if r[0]}:
        best = sorted((s, i) for kk, s, i, _ in rows if kk == k and s is not None)[:3]
        want += [(k, n + 1, i) for n, (_, i) in enumerate(best)]
    assert got == sorted(want)
    assert top_n(df.where("false"), "k", ["s", "i"], 3).count() == 0
