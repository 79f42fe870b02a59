"""Near ties over all pairs of every snapshot, pairs with an impact of 0 included."""

from decimal import Decimal
from itertools import combinations
from math import log10

from riverbed.plans.positions import near_ties

SCHEMA = """impact_id long, snapshot_index long, pool_address string, block_number long, current_tick int, position_key string, tick_lower int, tick_upper int, position_liquidity string,
  active_liquidity_share double, range_width int, distance_to_lower_tick int, distance_to_upper_tick int, distance_to_nearest_edge int, zero_for_one_lsis_bps decimal(38,18), one_for_zero_lsis_bps decimal(38,18), total_lsis_bps decimal(38,18)"""


def found(spark, tmp_path, positions):
    """``positions``: (snapshot, key, share, total)."""
    rows = [(i, n, "0x" + "ab" * 20, 100 + n, 0, k, -10, 10, "5", s, 20, 10, 10, 10, None, None, None if t is None else Decimal(str(t))) for i, (n, k, s, t) in enumerate(positions)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/position_impacts.parquet")
    return [(r.snapshot_index, r.key, r.other, r.score) for r in near_ties(spark, str(tmp_path)).collect()]


def expected(positions):
    best = {}
    for (n, k, s, t), (m, j, r, u) in combinations(positions, 2):
        if n != m or t is None or u is None or max(s, r) <= 0 or max(t, u) <= 0:
            continue
        gap = abs(s - r) / max(s, r)
        if gap <= 0.10:
            best.setdefault(n, []).append((-round((log10(max(t, u) / min(t, u)) if min(t, u) > 0 else 12.0) * (1 - gap), 9), n, min(k, j), max(k, j)))
    kept = sorted(x for rows in best.values() for x in sorted(rows)[:25])
    return [(n, k, j, -score) for score, n, k, j in sorted(kept)[:500]]


def test_pairs_with_an_impact_of_zero_rank_first(spark, tmp_path):
    positions = [(1, "a", 0.30, 2.0), (1, "b", 0.32, 0.0), (1, "c", 0.28, 40.0), (1, "d", 0.29, None), (1, "e", 0.0, 5.0), (2, "a", 0.1, 0.0), (2, "b", 0.1, 0.0)]
    got = found(spark, tmp_path, positions)
    assert got == expected(positions)
    assert [x[1:3] for x in got] == [("a", "b"), ("a", "c")]


def test_twenty_five_pairs_of_a_snapshot(spark, tmp_path):
    positions = [(n, f"k{i:02}", 0.05 * (1 + 0.013 * i), (i * 7 + n) % 5) for n in range(30) for i in range(12)]
    got = found(spark, tmp_path, positions)
    assert got == expected(positions) and len(got) == 500
