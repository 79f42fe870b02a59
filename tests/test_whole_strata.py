"""Matching of whole states and adjusted tests on the smallest tables against plain loops."""

import math
import os
from collections import defaultdict

import pandas as pd
import pytest

from riverbed.plans import statistics, study

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def strata(spark):
    rows = defaultdict(list)
    for r in study._wide(spark, FOLDER).collect():
        rows[r.pool, r.snapshot_index].append(r)
    return rows


def costs(rows):
    """Distances of wide from narrow positions, by identifiers as text, scaled over the whole state."""
    x = pd.DataFrame([[r.share or 0.0, float(r.distance_to_nearest_edge or 0)] for r in rows])
    s = x.std().where(lambda v: v > 0, 1.0).fillna(1.0) if len(x) > 1 else pd.Series([1.0, 1.0])
    at = {str(r.impact_id): (x.iloc[i] / s).tolist() for i, r in enumerate(rows)}
    wide = sorted(str(r.impact_id) for r in rows if r.wide)
    narrow = sorted(str(r.impact_id) for r in rows if not r.wide)
    return {a: {b: math.dist(at[a], at[b]) for b in narrow} for a in wide}


def test_matched_positions_equal_a_loop_over_whole_states(spark, strata):
    want = {}
    for rows in strata.values():
        d = costs(rows)
        pairs = {}
        for a in sorted(d, key=lambda a: -min(d[a].values(), default=0)):
            free = [b for b in d[a] if b not in pairs.values()]
            best = min(free, key=lambda b: d[a][b], default=None)
            if best is not None and d[a][best] <= study.CALIPER:
                pairs[a] = best
        cost = lambda a, b: d[a][b] if d[a][b] <= study.CALIPER else math.inf
        again, order = True, list(pairs)
        while again:
            again = False
            for i, a in enumerate(order):
                for c in order[i + 1 :]:
                    if cost(a, pairs[c]) + cost(c, pairs[a]) < cost(a, pairs[a]) + cost(c, pairs[c]) - 1e-12:
                        pairs[a], pairs[c], again = pairs[c], pairs[a], True
        want |= pairs
    got = {r.impact_id: r.control for r in study.matched_positions(spark, FOLDER).collect()}
    assert got == want and got


def test_controlled_positions_equal_a_loop_over_whole_states(spark, strata):
    total = {str(r.impact_id): r.total for rows in strata.values() for r in rows}
    want = {}
    for rows in strata.values():
        d, uses = costs(rows), defaultdict(int)
        near = {a: [b for b in sorted(d[a], key=lambda b: d[a][b]) if d[a][b] <= study.CALIPER] for a in d}
        for a in sorted((a for a in d if d[a]), key=lambda a: (len(near[a]), -min(d[a].values()), a)):
            chosen = [b for b in near[a] if uses[b] < 3][:3]
            for b in chosen:
                uses[b] += 1
            if chosen:
                want[a] = (len(chosen), total[a] - sum(total[b] for b in chosen) / len(chosen))
    got = {r.impact_id: (r.controls, r.excess) for r in study.controlled_positions(spark, FOLDER).collect()}
    assert got.keys() == want.keys() and all(got[a] == (want[a][0], pytest.approx(want[a][1])) for a in got)


def test_adjusted_tests(spark):
    z = {r.pool: r.z for r in statistics.signed_ranks(spark, FOLDER).collect()}
    p = {pool: math.erfc(abs(v) / math.sqrt(2)) for pool, v in z.items()}
    got = {(r.family, r.pool): (r.p, r.p_holm) for r in statistics.adjusted_tests(spark, FOLDER).collect()}
    families = {"all": sorted(p)} | {f: sorted(q for q in p if q[2] == f) for f in {q[2] for q in p}}
    assert got.keys() == {(f, q) for f, qs in families.items() for q in qs}
    for f, qs in families.items():
        worst = 0.0
        for i, q in enumerate(sorted(qs, key=lambda q: (p[q], q))):
            worst = max(worst, (len(qs) - i) * p[q])
            assert got[f, q] == (pytest.approx(p[q], abs=1e-6), pytest.approx(min(1.0, worst), abs=1e-6))
