"""Queries over the feed of liquidity actions: one delivery per action, and totals per pool in spite of hot pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.functions.exact import exact_cents, too_large
from riverbed.functions.keys import clean_address, clean_key
from riverbed.operators.chunks import per_key_totals
from riverbed.operators.ordered import conflicts
from riverbed.operators.redelivery import single_actions, streamed_repeats, with_actions, without_repeats
from riverbed.plans.base import LINKS, address_sql, key_sql, sql
from riverbed.session import cut, read

#: Share of all distinct actions from which a pool is reported.
HOT_SHARE = 0.02
#: What copies of an action should agree in.
PAYLOAD = ["pool", "action_type", "tx_hash", "block_number", "log_index", "owner", "tick_lower", "tick_upper", "liquidity_delta"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools with at least 2 % of the distinct actions, counted over one delivery per action.

    Actions without a pool count towards the total but are no pool.
    """
    feed = read(spark, sf_dir, "lp_actions").select("delivery_id", "id", clean_address("pool_address").alias("pool_address"), "block_number", "log_index")
    totals = cut(per_key_totals(single_actions(feed, ["delivery_id", "pool_address"], narrow=True), "pool_address", "delivery_id"))
    whole = totals.agg(F.sum("item_count").alias("whole"))
    return totals.crossJoin(F.broadcast(whole)).where(F.col("pool_address").isNotNull() & (F.col("item_count") >= F.col("whole") * HOT_SHARE)).select("pool_address")


def p1_pool_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries, distinct actions (linked as in p4) and the sum of finite amounts (in cents) of every pool.

    ``beyond`` counts finite amounts of a size that the exact sum does not hold (see ``exact_cents``).
    """
    feed = read(spark, sf_dir, "lp_actions").select(
        "delivery_id", "id", clean_address("pool_address").alias("pool_address"), "block_number", "log_index", exact_cents("amount_usd").alias("cents"), too_large("amount_usd").cast("int").alias("beyond")
    )
    rows = with_actions(feed, ["pool_address", "delivery_id", "cents", "beyond"])
    return per_key_totals(rows, "pool_address", "action", ["delivery_id"], "cents", also=["beyond"]).select("pool_address", "row_count", "item_count", F.col("amount_sum").cast("string").alias("cents"), "beyond")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivery but the first of its action."""
    return streamed_repeats(spark, f"{sf_dir}/lp_actions.parquet").select(F.col("delivery").alias("delivery_id"))


def p4_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed with exactly one delivery of each action."""
    repeats = streamed_repeats(spark, f"{sf_dir}/lp_actions.parquet")
    feed = read(spark, sf_dir, "lp_actions").select("delivery_id", clean_address("pool_address").alias("pool_address"), "action_type", "block_number", "log_index")
    return without_repeats(feed, repeats)


def action_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions delivered more than once: how many copies, and in how many versions; more than one is a conflict.

    ``id`` and place are those of the first delivery, which is the one kept.
    """
    a = read(spark, sf_dir, "lp_actions").select("delivery_id", clean_key("id").alias("id"), clean_address("pool_address").alias("pool"), clean_address("owner").alias("owner"), "action_type", "tx_hash", "block_number", "log_index", "tick_lower", "tick_upper", "liquidity_delta")
    rows = with_actions(a.select("delivery_id", "id", "block_number", "log_index", F.struct(*a.columns).alias("row")), ["row"]).where("action IS NOT NULL").select("action", "row.*")
    told = conflicts(rows, ["action"], PAYLOAD, first=("delivery_id", ["id", "block_number", "log_index"]))
    return told.select("delivery_id", "id", "block_number", "log_index", "copies", "versions")


_CENTS = "CASE WHEN isfinite(amount_usd) AND abs(amount_usd) < 1e26 THEN round_even(amount_usd * 100, 0) END"
_VERSION = "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in (address_sql("pool_address"), "action_type", "tx_hash", "block_number", "log_index", address_sql("owner"), "tick_lower", "tick_upper", "liquidity_delta")) + ")"

QUERIES = {f.__name__: f for f in (p1_found, p1_pool_totals, p4_found, p4_single, action_conflicts)}

ORACLE = {
    "p1_found": sql(LINKS, f"""SELECT pool_address FROM (
  SELECT {address_sql('a.pool_address')} AS pool_address, count(*) AS n, sum(count(*)) OVER () AS whole
  FROM first JOIN lp_actions a ON a.delivery_id = first.v WHERE first.v = first.r GROUP BY 1)
WHERE pool_address IS NOT NULL AND n >= whole * {HOT_SHARE}"""),
    "p1_pool_totals": sql(LINKS, f"""a AS (SELECT {address_sql('pool_address')} AS pool_address, r, coalesce(isfinite(amount_usd) AND abs(amount_usd) >= 1e26, false) AS beyond, {_CENTS} AS c FROM lp_actions JOIN first ON v = delivery_id)""", """SELECT pool_address, count(*) AS row_count, count(DISTINCT r) AS item_count,
  CAST(sum(CAST(floor(c / 4294967296.0::DOUBLE) AS HUGEINT) * 4294967296 + CAST(c - floor(c / 4294967296.0::DOUBLE) * 4294967296.0::DOUBLE AS HUGEINT)) AS VARCHAR) AS cents, count(*) FILTER (beyond) AS beyond
FROM a GROUP BY 1"""),
    "p4_found": sql(LINKS, "SELECT v AS delivery_id FROM first WHERE v <> r"),
    "p4_single": sql(LINKS, f"SELECT delivery_id, {address_sql('pool_address')} AS pool_address, action_type, block_number, log_index FROM first JOIN lp_actions a ON a.delivery_id = first.v WHERE v = r"),
    "action_conflicts": sql(LINKS, f"c AS (SELECT r, count(*) AS copies, count(DISTINCT {_VERSION}) AS versions FROM first JOIN lp_actions ON v = delivery_id GROUP BY 1 HAVING count(*) > 1)", f"SELECT r AS delivery_id, {key_sql('id')} AS id, block_number, log_index, copies, versions FROM c JOIN lp_actions ON r = delivery_id"),
}
