"""Data-quality queries: one row per rule with the rows that break it, and fingerprints of states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.plans.base import ACTIONS, IMPACTS, SNAPSHOTS, SWAPS, actions, impacts, snapshots, sql, swaps
from riverbed.session import read

#: By table, rules that a row keeps, as expressions that Spark and SQL read alike; an unknown outcome counts as broken.
RULES = {
    "pools": {"fee_known": "fee_tier IN (100, 500, 3000, 10000)", "spacing_positive": "tick_spacing > 0", "tokens_differ": "token0_address <> token1_address"},
    "lp_actions": {"range_rises": "tick_lower < tick_upper", "place_valid": "block_number > 0 AND log_index >= 0", "sign_fits": "(action_type = 1 AND liquidity_delta NOT LIKE '-%') OR (action_type = 2 AND liquidity_delta LIKE '-%')", "owner_known": "owner <> ''", "amount_known": "amount_usd >= 0"},
    "swaps": {"place_valid": "block_number > 0 AND log_index >= 0", "time_valid": "timestamp_unix > 0", "one_side_paid": "(amount0_raw LIKE '-%') <> (amount1_raw LIKE '-%')"},
    "pool_snapshots": {"tick_known": "tick IS NOT NULL", "price_positive": "sqrt_price_x96 NOT LIKE '-%' AND sqrt_price_x96 <> '0'"},
    "position_impacts": {"scored": "total_lsis_bps IS NOT NULL", "not_negative": "total_lsis_bps >= 0", "width_fits": "range_width = tick_upper - tick_lower", "edge_nearest": "distance_to_nearest_edge = least(abs(distance_to_lower_tick), abs(distance_to_upper_tick))"},
}


def broken_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table that break each of its rules, in one pass per table."""
    out = []
    for table, rules in RULES.items():
        counts = read(spark, sf_dir, table).agg(F.count("*").alias("rows"), *[F.count_if(~F.coalesce(F.expr(rule), F.lit(False))).alias(name) for name, rule in rules.items()])
        out.append(counts.unpivot(["rows"], list(rules), "rule", "broken").select(F.lit(table).alias("table_name"), "rule", "rows", "broken"))
    return reduce(DataFrame.unionByName, out)


def key_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools that one feed has and another lacks, by anti joins in both directions."""
    a, s, p = (t(spark, sf_dir).select("pool").where("pool IS NOT NULL").distinct() for t in (actions, swaps, snapshots))
    missing = lambda x, y, what: x.join(y, "pool", "left_anti").withColumn("missing_in", F.lit(what))
    return missing(a, s, "swaps").unionByName(missing(s, a, "lp_actions")).unionByName(missing(a, p, "pool_snapshots")).unionByName(missing(p, a, "lp_actions of pool_snapshots"))


def common_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools that all feeds have."""
    a, s, p = (t(spark, sf_dir).select("pool") for t in (actions, swaps, snapshots))
    return a.intersect(s).intersect(p)


def state_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint of the positions of each snapshot, the same in whatever order they are stored."""
    line = F.concat_ws("|", "key", "tick_lower", "tick_upper", F.col("liquidity").cast("string"))
    g = impacts(spark, sf_dir).where("key IS NOT NULL").groupBy("pool", "snapshot_index").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return g.select("pool", "snapshot_index", F.sha2(F.array_join("lines", "\n"), 256).alias("hash"))


def missing_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of each pool's positions that lack values, as one list, and how many values."""
    names = ["share", "current_tick", "total", "zero_for_one"]
    long = impacts(spark, sf_dir).select("pool", *[F.col(c).cast("double").alias(c) for c in names]).groupBy("pool").agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names]).unpivot(["pool"], names, "measure", "n").where("n > 0")
    return long.groupBy("pool").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "measure", "n"))), ";").alias("lacking"), F.sum("n").alias("values"))


QUERIES = {f.__name__: f for f in (broken_rules, key_differences, common_pools, state_hashes, missing_measures)}

_MISSING = " UNION ALL ".join(f"SELECT pool, '{c}' AS measure, count(*) FILTER ({c} IS NULL) AS n FROM impacts GROUP BY 1" for c in ("share", "current_tick", "total", "zero_for_one"))
ORACLE = {
    "broken_rules": " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{n}' AS rule, count(*) AS rows, count(*) FILTER (NOT coalesce({r}, false)) AS broken FROM {t}" for t, rules in RULES.items() for n, r in rules.items()),
    "key_differences": sql(ACTIONS, SWAPS, SNAPSHOTS, """SELECT pool, 'swaps' AS missing_in FROM (SELECT pool FROM actions EXCEPT SELECT pool FROM swapped) UNION ALL SELECT pool, 'lp_actions' FROM (SELECT pool FROM swapped EXCEPT SELECT pool FROM actions)
UNION ALL SELECT pool, 'pool_snapshots' FROM (SELECT pool FROM actions EXCEPT SELECT pool FROM snaps) UNION ALL SELECT pool, 'lp_actions of pool_snapshots' FROM (SELECT pool FROM snaps EXCEPT SELECT pool FROM actions)"""),
    "common_pools": sql(ACTIONS, SWAPS, SNAPSHOTS, "SELECT pool FROM actions INTERSECT SELECT pool FROM swapped INTERSECT SELECT pool FROM snaps"),
    "state_hashes": sql(IMPACTS, "l AS (SELECT pool, snapshot_index, concat_ws('|', key, tick_lower, tick_upper, CAST(liquidity AS VARCHAR)) AS line FROM impacts WHERE key IS NOT NULL)", "SELECT pool, snapshot_index, sha256(string_agg(line, chr(10) ORDER BY line)) AS hash FROM l GROUP BY 1, 2"),
    "missing_measures": sql(IMPACTS, f"m AS ({_MISSING})", "SELECT pool, string_agg(measure || ':' || n, ';' ORDER BY measure || ':' || n) AS lacking, CAST(sum(n) AS BIGINT) AS values FROM m WHERE n > 0 GROUP BY 1"),
}
