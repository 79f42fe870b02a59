"""The tables as the queries see them: canonical spelling, one row per event; in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.functions.keys import clean_address, clean_key
from riverbed.operators.ordered import first_per
from riverbed.operators.redelivery import single_actions
from riverbed.session import read

BLANK = r"E' \t\r\n'"


def key_sql(c: str) -> str:
    return f"nullif(lower(trim({c}, {BLANK})), '')"


def address_sql(c: str) -> str:
    t = f"lower(trim({c}, {BLANK}))"
    return f"CASE WHEN {t} LIKE '0x%' THEN {t} WHEN {t} <> '' THEN '0x' || {t} END"


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per action, its first delivery, in canonical spelling; an empty address is null.

    Deliveries are of one action if they share the id or the place in the chain, directly or over others.
    """
    rows = read(spark, sf_dir, "lp_actions").select(
        clean_key("id").alias("id"), "delivery_id", clean_address("pool_address").alias("pool"), "action_type", "block_number", "log_index",
        clean_address("owner").alias("owner"), F.when(F.col("owner").isNotNull() & clean_key("owner").isNull(), F.lit(True)).alias("unnamed"),
        "tick_lower", "tick_upper", F.col("liquidity_delta").cast("decimal(38,0)").alias("delta"), "amount_usd",
    )
    return single_actions(rows, rows.columns)


#: Of every delivery ``v`` the first delivery ``r`` of its action, in the table ``first``.
LINKS = f"""d AS (SELECT delivery_id AS v, {key_sql('id')} AS i, block_number AS b, log_index AS l FROM lp_actions),
hops AS (
  SELECT x.v AS u, y.v AS v FROM d x JOIN d y ON x.i = y.i AND x.v <> y.v
  UNION SELECT x.v, y.v FROM d x JOIN d y ON x.b = y.b AND x.l = y.l AND x.v <> y.v),
reach AS (
  SELECT v, v AS r FROM d
  UNION SELECT hops.v, reach.r FROM reach JOIN hops ON hops.u = reach.v),
first AS (SELECT v, min(r) AS r FROM reach GROUP BY v)"""

ACTIONS = LINKS + f""",
actions AS (SELECT {key_sql('id')} AS id, delivery_id, {address_sql('pool_address')} AS pool, action_type, block_number, log_index,
  {address_sql('owner')} AS owner, CASE WHEN owner IS NOT NULL AND {key_sql('owner')} IS NULL THEN true END AS unnamed, tick_lower, tick_upper, CAST(liquidity_delta AS HUGEINT) AS delta, amount_usd
  FROM lp_actions JOIN first ON v = delivery_id AND v = r)"""


def swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per place in the chain of a pool, the one of the least identifier."""
    rows = read(spark, sf_dir, "swaps").select(
        clean_key("id").alias("id"), clean_address("pool_address").alias("pool"), "block_number", "log_index", "timestamp_unix",
        F.col("amount0_raw").cast("decimal(38,0)").alias("amount0"), F.col("amount1_raw").cast("decimal(38,0)").alias("amount1"), "sqrt_price_x96", "tick_after",
    )
    return first_per(rows, ["pool", "block_number", "log_index"], ["id"])


SWAPS = f"""swapped AS (SELECT {key_sql('id')} AS id, {address_sql('pool_address')} AS pool, block_number, log_index, timestamp_unix,
  CAST(amount0_raw AS HUGEINT) AS amount0, CAST(amount1_raw AS HUGEINT) AS amount1, sqrt_price_x96, tick_after FROM swaps
  QUALIFY row_number() OVER (PARTITION BY {address_sql('pool_address')}, block_number, log_index ORDER BY {key_sql('id')}) = 1)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of each pool's snapshot that was written last; of equal times the greatest liquidity text."""
    rows = read(spark, sf_dir, "pool_snapshots").select(clean_address("pool_address").alias("pool"), "block_number", "sqrt_price_x96", "tick", "active_liquidity", "created_at")
    return first_per(rows, ["pool", "block_number"], [F.desc("created_at"), F.desc("active_liquidity"), F.desc_nulls_last("tick")])


SNAPSHOTS = f"""snaps AS (SELECT {address_sql('pool_address')} AS pool, block_number, sqrt_price_x96, tick, active_liquidity, created_at FROM pool_snapshots
  QUALIFY row_number() OVER (PARTITION BY {address_sql('pool_address')}, block_number ORDER BY created_at DESC, active_liquidity DESC, tick DESC NULLS LAST) = 1)"""


def impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per position and snapshot of a pool, the first exported; scores as doubles."""
    d = [F.col(c).cast("double").alias(c.replace("_lsis_bps", "")) for c in ("zero_for_one_lsis_bps", "one_for_zero_lsis_bps", "total_lsis_bps")]
    rows = read(spark, sf_dir, "position_impacts").select(
        "impact_id", "snapshot_index", clean_address("pool_address").alias("pool"), "block_number", "current_tick", clean_key("position_key").alias("key"), "tick_lower", "tick_upper",
        F.col("position_liquidity").cast("decimal(38,0)").alias("liquidity"), F.col("active_liquidity_share").alias("share"), "range_width", "distance_to_lower_tick", "distance_to_upper_tick", "distance_to_nearest_edge", *d,
    )
    return first_per(rows, ["pool", "snapshot_index", "key"], ["impact_id"])


IMPACTS = f"""impacts AS (SELECT impact_id, snapshot_index, {address_sql('pool_address')} AS pool, block_number, current_tick, {key_sql('position_key')} AS key, tick_lower, tick_upper,
  CAST(position_liquidity AS HUGEINT) AS liquidity, active_liquidity_share AS share, range_width, distance_to_lower_tick, distance_to_upper_tick, distance_to_nearest_edge,
  CAST(zero_for_one_lsis_bps AS DOUBLE) AS zero_for_one, CAST(one_for_zero_lsis_bps AS DOUBLE) AS one_for_zero, CAST(total_lsis_bps AS DOUBLE) AS total
  FROM position_impacts QUALIFY row_number() OVER (PARTITION BY {address_sql('pool_address')}, snapshot_index, {key_sql('position_key')} ORDER BY impact_id) = 1)"""


def sql(*parts: str) -> str:
    """A statement of common tables and, last, the query over them."""
    return "WITH RECURSIVE " + ",\n".join(parts[:-1]) + "\n" + parts[-1]
