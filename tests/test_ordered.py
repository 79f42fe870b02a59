import random
from collections import defaultdict

import pytest

from riverbed.operators.chunks import number_rows, per_key_totals
from riverbed.operators.ordered import after_cursor, asof, conflicts, first_per, haloed, neighbours, range_extremes, running_totals


def rows_of(n=400, seed=5):
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.randrange(60), i, rng.choice([1, 2, 5, None])) for i in range(n)]


def test_number_rows_counts_each_key_from_zero(spark):
    rows = rows_of()
    got = number_rows(spark.createDataFrame(rows, "k string, t int, i int, v int"), "k", ["t", "i"], partitions=7).collect()
    by = defaultdict(list)
    for r in got:
        by[r.k].append((r.t, r.i, r.row_in_key))
    assert len(got) == len(rows)
    for xs in by.values():
        assert [x[2] for x in sorted(xs)] == list(range(len(xs)))


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_per_key_totals(spark, chunk):
    rows = rows_of()
    got = {r.k: (r.row_count, r.item_count, r.amount_sum) for r in per_key_totals(spark.createDataFrame(rows, "k string, t int, i int, v int"), "k", "t", ["i"], "v", chunk_rows=chunk).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        want[k] = (len(own), len({r[1] for r in own}), sum(r[3] or 0 for r in own))
    assert got == want


def test_totals_of_nothing_and_of_null_items(spark):
    assert per_key_totals(spark.createDataFrame([], "k string, t int"), "k", "t").count() == 0
    r = per_key_totals(spark.createDataFrame([("a", None), ("a", None), ("a", 1)], "k string, t int"), "k", "t").first()
    assert (r.row_count, r.item_count, r.amount_sum) == (3, 1, None)


def test_running_totals(spark):
    rows = rows_of()
    got = {(r.k, r.t, r.i): r.v_upto for r in running_totals(spark.createDataFrame(rows, "k string, t int, i int, v int"), ["k"], ["t", "i"], ["v"]).collect()}
    for k, t, i, _ in rows:
        assert got[k, t, i] == sum(r[3] or 0 for r in rows if r[0] == k and (r[1], r[2]) <= (t, i))


def test_asof(spark):
    rng = random.Random(1)
    left = [(i, rng.choice(["x", "y", None]), rng.choice([None, *range(-50, 300)])) for i in range(150)]
    right = [(rng.choice(["x", "y", None]), rng.choice([None, *range(-40, 250)]), rng.randrange(5)) for _ in range(60)]
    got = {r.i: r.state for r in asof(spark.createDataFrame(left, "i int, k string, t long"), spark.createDataFrame(right, "k string, t long, v int"), "k", "t", "v", width=16).collect()}
    for i, k, t in left:
        known = [(rt, v) for rk, rt, v in right if k is not None and rk == k and t is not None and rt is not None and rt <= t]
        assert got[i] == (max(known)[1] if known else None), (i, k, t)
    assert asof(spark.createDataFrame([], "i int, k string, t long"), spark.createDataFrame(right, "k string, t long, v int"), "k", "t", "v").count() == 0


def test_haloed_rows_are_seen_from_every_bucket_in_reach(spark):
    df = haloed(spark.createDataFrame([("a", p) for p in range(0, 100, 3)], "k string, p long"), "k", "p", 10, back=4, ahead=7)
    seen = defaultdict(set)
    for r in df.collect():
        seen[r.bucket].add(r.p)
        assert r.own == (r.bucket == r.p // 10)
    for at in range(10, 90):
        assert {p for p in range(0, 100, 3) if at - 4 <= p <= at + 7} <= seen[at // 10]


def test_neighbours(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.randrange(5000)) for i in range(150)]
    got = {r.i: r.near for r in neighbours(spark.createDataFrame(rows, "i int, k string, p long"), "k", "p", 25).collect()}
    for i, k, p in rows:
        assert got[i] == any(j != i and kk == k and abs(pp - p) <= 25 for j, kk, pp in rows)


def test_cursor_conflicts_and_first(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, None), (2, 0, "c")], "block_number long, log_index int, v string")
    assert {(r.log_index, r.copies, r.versions) for r in conflicts(df, ["block_number", "log_index"], ["v"]).collect()} == {(1, 2, 1), (2, 2, 2)}
    assert df.where(after_cursor(1, 1, 1)).count() == 2 and df.where(after_cursor(1, 2)).count() == 1
    assert sorted(r.log_index for r in first_per(df, ["block_number"], ["log_index"]).collect()) == [0, 1]


def test_range_extremes(spark):
    rng = random.Random(8)
    values = {k: [rng.choice([None, *range(-50, 50)]) for _ in range(n)] for k, n in (("hot", 700), ("b", 5))}
    df = spark.createDataFrame([(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)], "k string, n long, v int")
    asked = [(rng.choice(["hot", "hot", "b", "none", None]), a, a + rng.choice([-1, 0, 1, 3, 20, 400])) for a in (rng.randrange(0, 300) for _ in range(200))] + [("b", 0, 4), ("hot", None, 3)]
    got = range_extremes(df, "k", "n", ["v"], spark.createDataFrame(asked, "k string, f long, l long"), "f", "l", block=4).collect()
    assert len(got) == len(asked)
    for r in got:
        own = [v for v in values.get(r.k, [])[r.f : r.l + 1] if v is not None] if r.f is not None and r.l >= r.f else []
        assert (r.v_least, r.v_most) == (min(own, default=None), max(own, default=None)), r


def test_running_maxima(spark):
    rows = rows_of()
    got = {(r.k, r.t, r.i): r.v_upto for r in running_totals(spark.createDataFrame(rows, "k string, t int, i int, v int"), ["k"], ["t", "i"], [], also_max=["v"]).collect()}
    for k, t, i, _ in rows:
        assert got[k, t, i] == max((r[3] for r in rows if r[0] == k and (r[1], r[2]) <= (t, i) and r[3] is not None), default=None)
