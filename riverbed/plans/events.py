"""Queries over ordered events: normalised rows, audits, scans by cursor, as-of and range joins, schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riverbed.functions.keys import clean_address, clean_key
from riverbed.functions.scalars import SPACING, direction, seeded_score, slug, spacing_of
from riverbed.operators.chunks import number_rows
from riverbed.operators.ordered import asof, conflicts, first_per, neighbours
from riverbed.plans.base import ACTIONS, SNAPSHOTS, SWAPS, actions, address_sql, snapshots, sql, swaps
from riverbed.session import cut, read

#: Blocks that must be free around a quiet one; blocks not yet safe.
QUIET, CONFIRMATIONS = 25, 20
#: Rows of a page; spacing, reach and number of scheduled snapshots; spacing of control candidates.
PAGE, STEP, LOOKBACK, MOST, STRIDE = 1000, 10_000, 300_000, 30, 1500


def pool_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pools")
    return p.select(clean_address("address").alias("pool"), "fee_tier", "tick_spacing", spacing_of(F.col("fee_tier")).alias("expected_spacing"), (F.col("token0_decimals") - F.col("token1_decimals")).cast("int").alias("decimals_gap"), "created_block")


def action_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = actions(spark, sf_dir)
    who = F.coalesce("owner", F.lit("unknown"))
    span = F.concat_ws(":", "tick_lower", "tick_upper")
    return a.select("id", "pool", F.when(F.col("action_type") == 1, "mint").when(F.col("action_type") == 2, "burn").alias("kind"), F.abs("delta").cast("string").alias("amount"), span.alias("range_key"), F.concat_ws(":", who, span).alias("position_key"))


def swap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = swaps(spark, sf_dir)
    a, b = F.col("amount0"), F.col("amount1")
    way = direction(a, b)
    paid, got = F.when(way == "zero_for_one", a).when(way == "one_for_zero", b), F.when(way == "zero_for_one", -b).when(way == "one_for_zero", -a)
    at = F.date_format(F.timestamp_seconds("timestamp_unix"), "yyyy-MM-dd HH:mm:ss")
    return s.select("pool", "block_number", "log_index", way.alias("direction"), paid.cast("string").alias("amount_in"), got.cast("string").alias("amount_out"), F.coalesce((paid > 0) & (got > 0), F.lit(False)).alias("simulable"), at.alias("at"))


def swap_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "swaps").withColumns({"pool": clean_address("pool_address"), "clean_id": clean_key("id")})
    return conflicts(s, ["pool", "block_number", "log_index"], ["tx_hash", "amount0_raw", "amount1_raw", "sqrt_price_x96", "tick_after"])


def first_swap_per_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_per(swaps(spark, sf_dir), ["pool", "block_number"], ["log_index"]).select("pool", "block_number", "log_index", "id")


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = actions(spark, sf_dir).select("pool", "block_number", "log_index", F.when(F.col("action_type") == 1, "mint").otherwise("burn").alias("kind"), "id", "delta")
    s = swaps(spark, sf_dir).select("pool", "block_number", "log_index", F.lit("swap").alias("kind"), "id", "amount0", "amount1", "tick_after")
    return a.unionByName(s, allowMissingColumns=True)


def event_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of a pool in the order of the chain, numbered from 0."""
    return number_rows(_timeline(spark, sf_dir).select("pool", "block_number", "log_index", "kind", "id"), "pool", ["block_number", "log_index", "kind", "id"]).withColumnRenamed("row_in_key", "event_no")


def asof_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each action with the liquidity of the pool's last snapshot at or before its block."""
    known = snapshots(spark, sf_dir).select("pool", "block_number", F.struct("block_number", "active_liquidity").alias("snapshot"))
    a = actions(spark, sf_dir).select("id", "pool", "block_number")
    return asof(a, known, "pool", "block_number", "snapshot").select("id", F.col("state.block_number").alias("snapshot_block"), F.col("state.active_liquidity").alias("active_liquidity"))


def clean_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of the same pool and block before each burn; none means a clean start."""
    a = actions(spark, sf_dir)
    earlier = F.row_number().over(Window.partitionBy("pool", "block_number").orderBy("log_index", "id")) - 1
    return a.withColumn("earlier", earlier).where("action_type = 2").select("id", "earlier", (F.col("earlier") == 0).alias("clean"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each pool that both feeds cover."""
    a = read(spark, sf_dir, "lp_actions").groupBy(clean_address("pool_address").alias("pool")).agg(F.min("block_number").alias("lp_first"), F.max("block_number").alias("lp_last"))
    s = read(spark, sf_dir, "swaps").groupBy(clean_address("pool_address").alias("pool")).agg(F.min("block_number").alias("swap_first"), F.max("block_number").alias("swap_last"))
    return a.join(s, "pool").select("pool", F.greatest("lp_first", "swap_first").alias("first"), F.least("lp_last", "swap_last").alias("through"))


def burn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burns by pages of 1,000 in the order of the chain, with the cursor that the next page starts after."""
    burns = actions(spark, sf_dir).where("action_type = 2 AND delta < 0").select("pool", "block_number", "log_index", "id")
    paged = number_rows(burns, "pool", ["block_number", "log_index", "id"]).withColumn("page", F.floor(F.col("row_in_key") / PAGE))
    pages = paged.groupBy("pool", "page").agg(F.count("*").alias("rows"), F.max(F.struct("block_number", "log_index")).alias("c"))
    last = pages.groupBy("pool").agg(F.max("page").alias("last"))
    more = F.col("page") < F.col("last")
    return pages.join(last, "pool").select("pool", "page", "rows", F.when(more, F.col("c.block_number")).alias("next_block"), F.when(more, F.col("c.log_index")).alias("next_log"))


def snapshot_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks from each pool's latest snapshot backwards in steps, with the snapshot that holds at each."""
    snaps = cut(snapshots(spark, sf_dir).select("pool", "block_number"))
    latest = snaps.groupBy("pool").agg(F.max("block_number").alias("latest"), F.min("block_number").alias("oldest"))
    back = F.sequence(F.lit(0).cast("long"), F.least(F.lit(MOST - 1).cast("long"), F.floor(F.least(F.lit(LOOKBACK).cast("long"), F.col("latest") - F.col("oldest")) / STEP)))
    wanted = latest.select("pool", F.posexplode(back).alias("place", "k"), "latest").select("pool", "place", (F.col("latest") - F.col("k") * STEP).alias("block_number"))
    return asof(wanted, snaps.withColumn("at", F.col("block_number")), "pool", "block_number", "at", out="snapshot_block")


def quiet_burns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burns without another action of their pool within 25 blocks."""
    a = actions(spark, sf_dir).select("id", "pool", "block_number", "action_type")
    return neighbours(a, "pool", "block_number", QUIET).where("action_type = 2 AND NOT near").select("id")


def control_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly spaced blocks of each pool that have no action within 25 blocks."""
    a = cut(actions(spark, sf_dir).select("pool", "block_number"))
    spans = a.groupBy("pool").agg(F.min("block_number").alias("lo"), F.max("block_number").alias("hi"))
    start = F.col("lo") + STRIDE // 2
    grid = spans.where(start <= F.col("hi")).select("pool", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("hi") - start) / STRIDE))).alias("k"), "lo")
    k = (F.col("block_number") - F.col("lo") - STRIDE // 2) / STRIDE
    near = a.join(spans, "pool").select("pool", F.round(k).cast("long").alias("k"), F.abs(F.round(k) - k).alias("off")).where(F.col("off") * STRIDE <= QUIET + 1e-6).select("pool", "k").distinct()
    return grid.join(near, ["pool", "k"], "left_anti").select("pool", (F.col("lo") + STRIDE // 2 + F.col("k") * STRIDE).alias("block_number"))


def confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of each pool that lie deep enough below the head of the chain, and those still withheld."""
    a = actions(spark, sf_dir)
    head = a.agg(F.max("block_number").alias("head"))
    safe = F.col("block_number") <= F.col("head") - CONFIRMATIONS
    return a.crossJoin(F.broadcast(head)).groupBy("pool").agg(F.count_if(safe).alias("confirmed"), F.count_if(~safe).alias("withheld"))


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snapshots(spark, sf_dir)
    return s.groupBy("pool").agg(F.max_by(F.struct("block_number", "sqrt_price_x96", "tick", "active_liquidity"), "block_number").alias("s")).select("pool", "s.*")


def source_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.groupBy(slug(F.col("source")).alias("slug")).agg(F.count("*").alias("pages"))


def seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reproducible score by which burns are drawn."""
    a = actions(spark, sf_dir).where("action_type = 2")
    return a.select("id", seeded_score(20260725, F.concat_ws(":", "pool", "block_number", "log_index")).alias("score"))


QUERIES = {f.__name__: f for f in (pool_dimension, action_rows, swap_rows, swap_conflicts, first_swap_per_block, event_timeline, asof_snapshot, clean_starts, coverage, burn_pages, snapshot_schedule, quiet_burns, control_candidates, confirmed, latest_snapshot, source_slugs, seeded_order)}

EVENTS = """events AS (SELECT pool, block_number, log_index, CASE WHEN action_type = 1 THEN 'mint' ELSE 'burn' END AS kind, id, delta, NULL::HUGEINT AS amount0, NULL::HUGEINT AS amount1, NULL::INT AS tick_after FROM actions
  UNION ALL SELECT pool, block_number, log_index, 'swap', id, NULL, amount0, amount1, tick_after FROM swapped)"""
_SPACING = "CASE fee_tier " + " ".join(f"WHEN {k} THEN {v}" for k, v in SPACING.items()) + " END"

ORACLE = {
    "pool_dimension": f"SELECT {address_sql('address')} AS pool, fee_tier, tick_spacing, {_SPACING} AS expected_spacing, CAST(token0_decimals AS INT) - token1_decimals AS decimals_gap, created_block FROM pools",
    "action_rows": sql(ACTIONS, """SELECT id, pool, CASE action_type WHEN 1 THEN 'mint' WHEN 2 THEN 'burn' END AS kind, CAST(abs(delta) AS VARCHAR) AS amount, tick_lower || ':' || tick_upper AS range_key,
  coalesce(owner, 'unknown') || ':' || tick_lower || ':' || tick_upper AS position_key FROM actions"""),
    "swap_rows": sql(SWAPS + """, w AS (SELECT *, CASE WHEN amount0 > 0 AND amount1 <= 0 THEN 'zero_for_one' WHEN amount1 > 0 AND amount0 <= 0 THEN 'one_for_zero' END AS direction FROM swapped),
v AS (SELECT *, CASE direction WHEN 'zero_for_one' THEN amount0 WHEN 'one_for_zero' THEN amount1 END AS i, CASE direction WHEN 'zero_for_one' THEN -amount1 WHEN 'one_for_zero' THEN -amount0 END AS o FROM w)""", """SELECT pool, block_number, log_index, direction, CAST(i AS VARCHAR) AS amount_in, CAST(o AS VARCHAR) AS amount_out, coalesce(i > 0 AND o > 0, false) AS simulable, strftime(make_timestamp(timestamp_unix * 1000000), '%Y-%m-%d %H:%M:%S') AS at FROM v"""),
    "swap_conflicts": f"""SELECT {address_sql('pool_address')} AS pool, block_number, log_index, count(*) AS copies, count(DISTINCT concat_ws('|', coalesce(tx_hash, '~'), coalesce(amount0_raw, '~'), coalesce(amount1_raw, '~'), coalesce(sqrt_price_x96, '~'), coalesce(CAST(tick_after AS VARCHAR), '~'))) AS versions
FROM swaps GROUP BY ALL HAVING count(*) > 1""",
    "first_swap_per_block": sql(SWAPS, "SELECT pool, block_number, log_index, id FROM swapped QUALIFY row_number() OVER (PARTITION BY pool, block_number ORDER BY log_index) = 1"),
    "event_timeline": sql(ACTIONS, SWAPS, EVENTS, "SELECT pool, block_number, log_index, kind, id, row_number() OVER (PARTITION BY pool ORDER BY block_number, log_index, kind, id) - 1 AS event_no FROM events"),
    "asof_snapshot": sql(ACTIONS, SNAPSHOTS, "SELECT a.id, s.block_number AS snapshot_block, s.active_liquidity FROM actions a ASOF LEFT JOIN snaps s ON a.pool = s.pool AND a.block_number >= s.block_number"),
    "clean_starts": sql(ACTIONS, "SELECT id, earlier, earlier = 0 AS clean FROM (SELECT *, row_number() OVER (PARTITION BY pool, block_number ORDER BY log_index, id) - 1 AS earlier FROM actions) WHERE action_type = 2"),
    "coverage": f"""SELECT pool, greatest(a.lo, s.lo) AS first, least(a.hi, s.hi) AS through FROM (SELECT {address_sql('pool_address')} AS pool, min(block_number) AS lo, max(block_number) AS hi FROM lp_actions GROUP BY 1) a
JOIN (SELECT {address_sql('pool_address')} AS pool, min(block_number) AS lo, max(block_number) AS hi FROM swaps GROUP BY 1) s USING (pool)""",
    "burn_pages": sql(ACTIONS, f"""n AS (SELECT *, (row_number() OVER (PARTITION BY pool ORDER BY block_number, log_index, id) - 1) // {PAGE} AS page FROM actions WHERE action_type = 2 AND delta < 0),
p AS (SELECT pool, page, count(*) AS rows, arg_max(block_number, block_number * 1000000 + log_index) AS b, arg_max(log_index, block_number * 1000000 + log_index) AS l FROM n GROUP BY 1, 2)""", """SELECT pool, page, rows, CASE WHEN page < max(page) OVER (PARTITION BY pool) THEN b END AS next_block, CASE WHEN page < max(page) OVER (PARTITION BY pool) THEN l END AS next_log FROM p"""),
    "snapshot_schedule": sql(SNAPSHOTS, f"""r AS (SELECT pool, max(block_number) AS hi, min(block_number) AS lo FROM snaps GROUP BY 1),
w AS (SELECT pool, k AS place, hi - k * {STEP} AS block_number FROM r, range({MOST}) t(k) WHERE k * {STEP} <= least({LOOKBACK}, hi - lo))""", "SELECT w.pool, w.place, w.block_number, s.block_number AS snapshot_block FROM w ASOF LEFT JOIN snaps s ON s.pool = w.pool AND w.block_number >= s.block_number"),
    "quiet_burns": sql(ACTIONS, f"SELECT id FROM actions b WHERE action_type = 2 AND NOT EXISTS (SELECT 1 FROM actions a WHERE a.pool = b.pool AND a.id <> b.id AND a.block_number BETWEEN b.block_number - {QUIET} AND b.block_number + {QUIET})"),
    "control_candidates": sql(ACTIONS, f"""g AS (SELECT pool, unnest(range(min(block_number) + {STRIDE // 2}, max(block_number) + 1, {STRIDE})) AS block_number FROM actions GROUP BY pool)""", f"SELECT g.pool, g.block_number FROM g WHERE NOT EXISTS (SELECT 1 FROM actions a WHERE a.pool = g.pool AND a.block_number BETWEEN g.block_number - {QUIET} AND g.block_number + {QUIET})"),
    "confirmed": sql(ACTIONS, f"SELECT pool, count(*) FILTER (block_number <= head - {CONFIRMATIONS}) AS confirmed, count(*) FILTER (block_number > head - {CONFIRMATIONS}) AS withheld FROM actions, (SELECT max(block_number) AS head FROM actions) GROUP BY pool"),
    "latest_snapshot": sql(SNAPSHOTS, "SELECT pool, block_number, sqrt_price_x96, tick, active_liquidity FROM snaps QUALIFY row_number() OVER (PARTITION BY pool ORDER BY block_number DESC) = 1"),
    "source_slugs": "SELECT coalesce(nullif(trim(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'pool') AS slug, count(*) AS pages FROM documents GROUP BY 1",
    "seeded_order": sql(ACTIONS, f"SELECT id, sha256(unhex('{(20260725).to_bytes(8, 'big').hex()}') || encode(pool || ':' || block_number || ':' || log_index)) AS score FROM actions WHERE action_type = 2"),
}
