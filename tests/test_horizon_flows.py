"""Actions after every burn at all horizons of the study."""

from riverbed.plans.study import HORIZONS, horizon_flows

SCHEMA = "id string, delivery_id long, pool_address string, action_type short, block_number long, log_index int, owner string, tick_lower int, tick_upper int, liquidity_delta string, amount_usd double"


def test_all_horizons_against_all_pairs(spark, tmp_path):
    # blocks far apart and close by, a pool without burns, an action without a pool; a place holds one action
    events = [(p, 2 if (i * 5 + len(p)) % 3 else 1, 1000 + (i * i * 37) % 20_000 // (1 + 49 * (i % 2)), 2 * i + len(p) % 2) for p in ("aa", "bbb") for i in range(120)]
    events += [("aa", 2, 1000, 900), ("aa", 2, 1000, 901), ("c", 1, 1000, 902), (None, 2, 1000, 903), ("aa", 2, 8200, 904), ("aa", 1, 8201, 905)]
    rows = [(f"id{n}", n, p, k, b, i, None, 0, 1, "1", 1.0) for n, (p, k, b, i) in enumerate(events)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/lp_actions.parquet")
    got = {r.horizon: (r.burns, r.events, r.violations) for r in horizon_flows(spark, str(tmp_path)).collect()}
    burns = [x for x in events if x[1] == 2]
    after = lambda x, h: sum(x[0] is not None and p == x[0] and (b, i) > x[2:] and b <= x[2] + h for p, _, b, i in events)
    assert got == {h: (len(burns), sum(after(x, h) for x in burns), 0) for h in HORIZONS}
