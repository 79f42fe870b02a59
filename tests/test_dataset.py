"""Pairs, placebos and their statistics on the smallest tables: properties, and brute force from what they build on."""

import os

import pandas as pd
import pytest

from riverbed.plans import dataset, events, flows
from riverbed.session import cut

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def market(spark):
    return flows.market_controls(spark, FOLDER).toPandas()


def test_pairs_are_of_one_pool_and_location_and_leave_nobody_out(spark, market):
    states = dataset._spaced_states(spark, FOLDER).toPandas().set_index("id")
    pairs = dataset.paired_burns(spark, FOLDER).toPandas()
    used = [*pairs["high"], *pairs["low"]]
    assert len(used) == len(set(used)) and len(pairs) == sum(n // 2 for n in states.groupby(["pool", "location"]).size())
    for r in pairs.itertuples():
        high, low = states.loc[r.high], states.loc[r.low]
        assert high["pool"] == low["pool"] == r.pool and high["location"] == low["location"] == r.location and high["fraction"] >= low["fraction"]
    m = market.set_index(["id", "horizon"])["return_size_bps"]
    want = {(r.high, h): m[r.high, h] - m[r.low, h] for r in pairs.itertuples() for h in flows.HORIZONS if (r.high, h) in m and (r.low, h) in m}
    got = {(r.high, r.horizon): r.return_gap for r in dataset.pair_outcomes(spark, FOLDER).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_statistics_of_pairs(spark):
    rows = dataset.pair_outcomes(spark, FOLDER).toPandas()
    both = pd.concat([rows.assign(stratum="all"), rows.assign(stratum=rows["location"])])
    got = {(r.stratum, r.horizon): r for r in dataset.pair_statistics(spark, FOLDER).collect()}
    cells = both.groupby(["stratum", "horizon"])["return_gap"]
    assert got.keys() == set(cells.groups)
    for cell, gaps in cells:
        r = got[cell]
        assert (r.n, r.mean, r.median) == (len(gaps), pytest.approx(gaps.mean(), abs=1e-5), pytest.approx(gaps.median(), abs=1e-5))
        assert r.positive_share == pytest.approx((gaps > 0).mean()) and r.p <= r.p_holm <= 1


def test_placebos_are_quiet_blocks_far_from_the_burn(spark, market):
    states = dataset._spaced_states(spark, FOLDER).toPandas().set_index("id")
    free = {(r.pool, r.block_number) for r in events.control_candidates(spark, FOLDER).collect()}
    m = cut(dataset.placebo_matches(spark, FOLDER)).toPandas()
    assert len(m) and m.groupby("id").size().max() <= 3 and m.groupby(["pool", "control_block"]).size().max() <= 3
    for r in m.itertuples():
        assert (r.pool, r.control_block) in free and states.loc[r.id]["pool"] == r.pool
        assert abs(states.loc[r.id]["block_number"] - r.control_block) >= dataset.SEPARATION and r.distance <= dataset.CALIPER
    out = dataset.placebo_outcomes(spark, FOLDER).toPandas()
    known = set(zip(market["id"], market["horizon"]))
    assert all((r.id, r.horizon) in known and 1 <= r.placebos <= 3 for r in out.itertuples())
    assert {r.horizon: r.n for r in dataset.placebo_statistics(spark, FOLDER).collect()} == {str(h): n for h, n in out.groupby("horizon").size().items()}
