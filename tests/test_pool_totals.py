"""Totals per pool count actions, linked over identifiers and positions, not identifiers."""

from datetime import datetime

import pytest

from riverbed.plans.deliveries import p1_pool_totals

from test_redelivery import brute, feed

SCHEMA = "delivery_id long, id string, block_number long, log_index int, block_timestamp timestamp, pool_address string, amount_usd double"


def totals(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/lp_actions.parquet")
    return {r.pool_address: (r.row_count, r.item_count, r.cents) for r in p1_pool_totals(spark, str(tmp_path)).collect()}


def test_an_action_under_two_identifiers_counts_once(spark, tmp_path):
    t = datetime(2021, 1, 1)
    rows = [(1, "a", 10, 1, t, "AB", 1.0), (2, "b", 10, 1, t, "0xab", 2.0), (3, " B ", 11, 1, t, "ab", None), (4, None, 11, 1, t, "ab", 0.5)]
    rows += [(5, None, 12, 1, t, "ab", 1.0), (6, "", 12, 2, t, "ab", 1.0), (7, None, None, 1, t, "ab", 1.0), (8, None, None, 1, t, "ab", 1.0), (9, "z", 1, 1, t, "cd", 1.0), (None, "y", 2, 2, t, "cd", 1.0)]
    assert totals(spark, tmp_path, rows) == {"0xab": (8, 5, "750"), "0xcd": (2, 1, "200")}


@pytest.mark.parametrize("seed", [1, 2])
def test_actions_equal_union_find(spark, tmp_path, seed):
    rows = feed(seed)
    got = totals(spark, tmp_path, [(*r[:5], "ab", 1.0) for r in rows])
    assert got == {"0xab": (len(rows), len(brute(rows)), str(100 * len(rows)))}
