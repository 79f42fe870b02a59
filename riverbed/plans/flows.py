"""What happens in a pool after each burn: flows, the path of the tick, and how market and range have changed.

Nothing joins burns to the events of their windows.  Events have running totals by place in the chain; what lies in a
window is the totals at its end less those at the burn, and the extremes of the path are those of a range of numbered
swaps.  The work is that of the events and of the burns, however many events a window holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.functions.exact import mean_down, mean_down_sql
from riverbed.functions.scalars import direction, location
from riverbed.operators.chunks import number_rows
from riverbed.operators.ordered import asof, range_extremes, running_totals
from riverbed.plans.base import ACTIONS, SNAPSHOTS, SWAPS, actions, snapshots, sql, swaps
from riverbed.plans.events import EVENTS
from riverbed.session import cut

#: Blocks after a burn at which its outcomes are read, and those of the short window.
HORIZONS, HORIZON = [10, 100, 1000, 7200], 20
PLACE = ["pool", "block_number", "log_index"]
COUNTS = ["swaps", "zero_for_one", "one_for_zero", "mints", "burns"]
AMOUNTS = ["in0", "out0", "in1", "out1", "minted", "burned"]
PATH = ["tick_variation", "tick_squares"]


def _numbered_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swaps of each pool numbered from 0, with the step of the tick from the swap before."""
    s = number_rows(swaps(spark, sf_dir).where("pool IS NOT NULL").select(*PLACE, "amount0", "amount1", F.col("tick_after").alias("tick")), "pool", PLACE[1:]).withColumnRenamed("row_in_key", "swap_no")
    s = cut(s)
    before = s.select("pool", (F.col("swap_no") + 1).alias("swap_no"), F.col("tick").alias("tick_before"))
    return cut(s.join(before, ["pool", "swap_no"], "left").withColumn("step", F.abs(F.col("tick") - F.col("tick_before")).cast("long")).drop("tick_before"))


def _totals(events: DataFrame, s: DataFrame) -> DataFrame:
    """Per place of a pool the totals up to it, and the tick after the last swap so far."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    zero = F.lit(0).cast("decimal(38,0)")
    part = lambda c, sign: F.greatest(F.col(c) * sign, F.lit(0)).cast("decimal(38,0)")
    way = direction(F.col("amount0"), F.col("amount1"))
    flag = lambda x: F.coalesce(x.cast("long"), none)
    moved = s.select(
        *PLACE, one.alias("swaps"), flag(way == "zero_for_one").alias("zero_for_one"), flag(way == "one_for_zero").alias("one_for_zero"), none.alias("mints"), none.alias("burns"),
        part("amount0", 1).alias("in0"), part("amount0", -1).alias("out0"), part("amount1", 1).alias("in1"), part("amount1", -1).alias("out1"), zero.alias("minted"), zero.alias("burned"),
        F.col("step").alias("tick_variation"), (F.col("step") * F.col("step")).alias("tick_squares"), F.struct("block_number", "log_index", "tick").alias("last"),
    )
    a = events.where("pool IS NOT NULL AND block_number IS NOT NULL AND log_index IS NOT NULL")
    held = a.select(*PLACE, flag(F.col("action_type") == 1).alias("mints"), flag(F.col("action_type") == 2).alias("burns"), part("delta", 1).alias("minted"), part("delta", -1).alias("burned"))
    both = moved.unionByName(held, allowMissingColumns=True).groupBy(*PLACE).agg(*[F.coalesce(F.sum(c).cast("decimal(38,0)" if c in AMOUNTS else "long"), F.lit(0)).alias(c) for c in COUNTS + AMOUNTS + PATH], F.max("last").alias("last"))
    return cut(running_totals(both, ["pool"], PLACE[1:], COUNTS + AMOUNTS + PATH, also_max=["last"]).select(*PLACE, F.struct("log_index", *[F.col(f"{c}_upto").alias(c) for c in COUNTS + AMOUNTS + PATH], F.col("last_upto.tick").alias("tick")).alias("upto")))


def _flows(spark: SparkSession, sf_dir: str, horizons: list[int]) -> tuple[DataFrame, DataFrame]:
    """Burns by horizon with the totals at the burn, ``own``, and at the horizon, ``state``; and the numbered swaps."""
    s = _numbered_swaps(spark, sf_dir)
    a = cut(actions(spark, sf_dir).select("id", *PLACE, "action_type", "delta"))
    t = _totals(a, s)
    b = a.where("action_type = 2").select("id", *PLACE).join(t.withColumnRenamed("upto", "own"), PLACE, "left")
    due = b.select("id", "pool", "own", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"), "block_number").withColumn("block_number", F.col("block_number") + F.col("horizon"))
    return asof(due, t, "pool", "block_number", "upto"), s


def _more(c: str) -> Column:
    """What the window adds to a total."""
    return F.coalesce(F.col(f"state.{c}") - F.col(f"own.{c}"), F.lit(0))


def flow_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows and the path of the tick from each burn, outside, to each horizon, inside.

    ``in`` and ``out`` are what the pool got and paid of a token.  The path starts at the tick after the last swap before
    the burn, null where there was none; it then starts at the window's first swap.  A burn without a pool has no flows.
    """
    found, s = _flows(spark, sf_dir, HORIZONS)
    span = found.withColumn("first", F.col("own.swaps")).withColumn("final", F.col("state.swaps") - 1)
    path = range_extremes(s, "pool", "swap_no", ["tick", "step"], span, "first", "final")
    text = lambda c: c.cast("decimal(38,0)").cast("string")
    start = F.col("own.tick")
    low, high = F.least(start, "tick_least"), F.greatest(start, "tick_most")
    return path.select(
        "id", "horizon", *[_more(c).alias(c) for c in COUNTS], *[text(_more(c)).alias(c) for c in AMOUNTS], text(_more("in0") + _more("out0")).alias("volume0"), text(_more("in1") + _more("out1")).alias("volume1"),
        text(_more("minted") - _more("burned")).alias("net"), start.alias("tick_start"), F.coalesce("state.tick", start).alias("tick_end"), low.alias("tick_min"), high.alias("tick_max"), (high - low).alias("tick_range"),
        *[_more(c).alias(c) for c in PATH], F.coalesce("step_most", F.lit(0).cast("long")).alias("tick_step_max"),
    )


def flow_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happened in a pool after each burn and up to 20 blocks on: events, volumes, liquidity, path of the tick.

    Here the path is that of the window's own swaps: its first swap is where it starts.
    """
    found, s = _flows(spark, sf_dir, [HORIZON])
    span = found.withColumn("first", F.col("own.swaps")).withColumn("final", F.col("state.swaps") - 1)
    path = range_extremes(s, "pool", "swap_no", ["tick"], span, "first", "final").join(s.select("pool", F.col("swap_no").alias("first"), "step"), ["pool", "first"], "left")
    into = F.when(_more("swaps") > 0, F.coalesce("step", F.lit(0))).otherwise(F.lit(0))
    text = lambda c: c.cast("decimal(38,0)").cast("string")
    return path.select(
        "id", *[_more(c).alias(c) for c in ("swaps", "mints", "burns")], text(_more("in0")).alias("in0"), text(_more("in1")).alias("in1"), text(_more("minted") - _more("burned")).alias("net"),
        F.col("tick_least").alias("tick_min"), F.col("tick_most").alias("tick_max"), (_more("tick_variation") - into).alias("tick_variation"),
    )


def flow_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per measure and horizon its sum over all burns, and the burns of which it is less than at the horizon before (none)."""
    found, _ = _flows(spark, sf_dir, HORIZONS)
    names = [c for c in COUNTS + AMOUNTS if c != "swaps"]
    wide = found.select("id", "horizon", *[_more(c).cast("decimal(38,0)").alias(c) for c in names]).groupBy("id").pivot("horizon", HORIZONS).agg(*[F.first(c).alias(c) for c in names])
    rows = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.lit(h).alias("horizon"), F.col(f"{h}_{c}").alias("v"), (F.col(f"{h}_{c}") < F.col(f"{HORIZONS[i - 1]}_{c}") if i else F.lit(False)).alias("less")) for c in names for i, h in enumerate(HORIZONS)])).alias("x")).select("x.*")
    return rows.groupBy("measure", "horizon").agg(F.sum("v").cast("string").alias("total"), F.count_if("less").alias("violations"))


def _liquidity(c: str) -> Column:
    return F.col(c).cast("decimal(38,0)")


def market_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How tick, price, range and active liquidity differ at each horizon from what they were around the burn.

    Before the burn the pool's last snapshot up to its block holds; after it, its liquidity less what the burn takes out
    if the tick is in the burn's range.  Rows without a snapshot with a tick, or beyond the pool's last one, are not
    observed: they are left out.  A change from no liquidity has a null fraction.
    """
    snaps = cut(snapshots(spark, sf_dir).where("tick IS NOT NULL").select("pool", "block_number", F.struct("block_number", "tick", F.col("sqrt_price_x96").alias("price"), "active_liquidity").alias("s")))
    head = snaps.groupBy("pool").agg(F.max("block_number").alias("head"))
    b = actions(spark, sf_dir).where("action_type = 2").select("id", "pool", "block_number", "tick_lower", "tick_upper", "delta")
    before = asof(b, snaps, "pool", "block_number", "s", out="was").where("was IS NOT NULL")
    due = before.join(head, "pool").withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in HORIZONS]))).withColumn("block_number", F.col("block_number") + F.col("horizon")).where("block_number <= head")
    at = asof(due, snaps, "pool", "block_number", "s", out="now")
    inside = location(F.col("was.tick"), F.col("tick_lower"), F.col("tick_upper")) == "active"
    left = (_liquidity("was.active_liquidity") + F.when(inside, F.col("delta")).otherwise(F.lit(0))).cast("decimal(38,0)")
    change = (_liquidity("now.active_liquidity") - left).cast("decimal(38,0)")
    moved = (F.col("now.tick") - F.col("was.tick"))
    back = (F.pow(F.col("now.price").cast("double") / F.col("was.price").cast("double"), F.lit(2.0)) - 1) * 10_000
    where = location(F.col("now.tick"), F.col("tick_lower"), F.col("tick_upper"))
    return at.select(
        "id", "horizon", moved.alias("tick_change"), F.abs(moved).alias("tick_distance"), F.round(back, 6).alias("return_bps"), F.round(F.abs(back), 6).alias("return_size_bps"), where.alias("location"), (where == "active").alias("active"),
        change.cast("string").alias("liquidity_change"), F.round(F.when(left > 0, change.cast("double") / left.cast("double")), 9).alias("change_fraction"),
    )


def horizon_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market controls over overlapping groups: all burns, and those whose range is active or not at the horizon."""
    m = market_controls(spark, sf_dir).withColumn("stratum", F.explode(F.array(F.lit("all"), F.when(F.col("active"), "active").otherwise("inactive"))))
    return m.groupBy("stratum", "horizon").agg(F.count("*").alias("n"), mean_down("return_bps").alias("mean_return"), mean_down("tick_distance").alias("mean_distance"), F.round(F.count_if(F.col("return_bps") > 0) / F.count("*"), 9).alias("positive_share"))


QUERIES = {f.__name__: f for f in (flow_controls, flow_windows, flow_growth, market_controls, horizon_changes)}

_STEPS = """st AS (SELECT pool, block_number, log_index, amount0, amount1, tick_after AS tick, block_number * 1000000 + log_index AS c, abs(tick_after - lag(tick_after) OVER (PARTITION BY pool ORDER BY block_number, log_index)) AS step FROM swapped WHERE pool IS NOT NULL),
bs AS (SELECT a.*, s.tick AS tick_start FROM (SELECT *, block_number * 1000000 + log_index AS c FROM actions WHERE action_type = 2) a ASOF LEFT JOIN st s ON s.pool = a.pool AND a.c >= s.c),
hs AS (SELECT unnest(%s) AS horizon)""" % HORIZONS
_WINDOWS = """sw AS (SELECT b.id, horizon, count(*) AS swaps, count(*) FILTER (amount0 > 0 AND amount1 <= 0) AS zero_for_one, count(*) FILTER (amount1 > 0 AND amount0 <= 0) AS one_for_zero, sum(greatest(amount0, 0)) AS in0, sum(greatest(-amount0, 0)) AS out0, sum(greatest(amount1, 0)) AS in1, sum(greatest(-amount1, 0)) AS out1,
  min(tick) AS lo, max(tick) AS hi, arg_max(tick, st.c) AS tick_end, sum(step) AS tv, sum(step * step) AS qv, max(step) AS big FROM bs b, hs JOIN st ON st.pool = b.pool AND st.c > b.c AND st.block_number <= b.block_number + horizon GROUP BY 1, 2),
lp AS (SELECT b.id, horizon, count(*) FILTER (e.action_type = 1) AS mints, count(*) FILTER (e.action_type = 2) AS burns, sum(greatest(e.delta, 0)) AS minted, sum(greatest(-e.delta, 0)) AS burned
  FROM bs b, hs JOIN actions e ON e.pool = b.pool AND (e.block_number, e.log_index) > (b.block_number, b.log_index) AND e.block_number <= b.block_number + horizon GROUP BY 1, 2),
fl AS (SELECT b.id, horizon, b.tick_start, coalesce(swaps, 0) AS swaps, coalesce(zero_for_one, 0) AS zero_for_one, coalesce(one_for_zero, 0) AS one_for_zero, coalesce(mints, 0) AS mints, coalesce(burns, 0) AS burns,
  coalesce(in0, 0)::HUGEINT AS in0, coalesce(out0, 0)::HUGEINT AS out0, coalesce(in1, 0)::HUGEINT AS in1, coalesce(out1, 0)::HUGEINT AS out1, coalesce(minted, 0)::HUGEINT AS minted, coalesce(burned, 0)::HUGEINT AS burned, lo, hi, tick_end, tv, qv, big
  FROM bs b CROSS JOIN hs LEFT JOIN sw USING (id, horizon) LEFT JOIN lp USING (id, horizon))"""
_TEXTS = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in AMOUNTS)
_GROWTH = " UNION ALL ".join(f"SELECT '{c}' AS measure, horizon, CAST({c} AS HUGEINT) AS v, {c} < lag({c}) OVER (PARTITION BY id ORDER BY horizon) AS less FROM fl" for c in COUNTS + AMOUNTS if c != "swaps")
MARKET = f"""sn AS (SELECT * FROM snaps WHERE tick IS NOT NULL), heads AS (SELECT pool, max(block_number) AS head FROM sn GROUP BY 1),
w AS (SELECT a.id, a.pool, a.block_number, a.tick_lower, a.tick_upper, a.delta, s.tick AS t0, s.sqrt_price_x96 AS p0, s.active_liquidity AS l0 FROM actions a ASOF JOIN sn s ON s.pool = a.pool AND a.block_number >= s.block_number WHERE a.action_type = 2),
x AS (SELECT w.* EXCLUDE (block_number), w.block_number + horizon AS block_number, horizon FROM w JOIN heads USING (pool), (SELECT unnest({HORIZONS}) AS horizon) WHERE w.block_number + horizon <= head),
y AS (SELECT x.*, s.tick AS t1, s.sqrt_price_x96 AS p1, s.active_liquidity AS l1, CAST(l0 AS HUGEINT) + CASE WHEN t0 >= tick_lower AND t0 < tick_upper THEN delta ELSE 0 END AS left_ FROM x ASOF JOIN sn s ON s.pool = x.pool AND x.block_number >= s.block_number),
m AS (SELECT id, horizon, t1 - t0 AS tick_change, abs(t1 - t0) AS tick_distance, round((pow(CAST(p1 AS DOUBLE) / CAST(p0 AS DOUBLE), 2) - 1) * 10000, 6) AS return_bps, round(abs((pow(CAST(p1 AS DOUBLE) / CAST(p0 AS DOUBLE), 2) - 1) * 10000), 6) AS return_size_bps,
  CASE WHEN t1 < tick_lower THEN 'below_current_tick' WHEN t1 >= tick_upper THEN 'above_current_tick' ELSE 'active' END AS location, t1 >= tick_lower AND t1 < tick_upper AS active,
  CAST(CAST(l1 AS HUGEINT) - left_ AS VARCHAR) AS liquidity_change, round(CASE WHEN left_ > 0 THEN CAST(CAST(l1 AS HUGEINT) - left_ AS DOUBLE) / CAST(left_ AS DOUBLE) END, 9) AS change_fraction FROM y)"""

_FLOW = f"""flows AS (SELECT id, horizon, swaps, zero_for_one, one_for_zero, mints, burns, {_TEXTS}, CAST(in0 + out0 AS VARCHAR) AS volume0, CAST(in1 + out1 AS VARCHAR) AS volume1, CAST(minted - burned AS VARCHAR) AS net, tick_start, coalesce(tick_end, tick_start) AS tick_end,
  least(lo, tick_start) AS tick_min, greatest(hi, tick_start) AS tick_max, greatest(hi, tick_start) - least(lo, tick_start) AS tick_range, coalesce(tv, 0)::BIGINT AS tick_variation, coalesce(qv, 0)::BIGINT AS tick_squares, coalesce(big, 0) AS tick_step_max FROM fl)"""
#: Common tables that end in ``flows``, the rows of ``flow_controls``; ``MARKET`` ends in ``m``, those of ``market_controls``.
FLOWS = [_STEPS, _WINDOWS, _FLOW]

ORACLE = {
    "flow_controls": sql(ACTIONS, SWAPS, *FLOWS, "SELECT * FROM flows"),
    "flow_windows": sql(ACTIONS, SWAPS, EVENTS, f"""j AS (SELECT b.id, e.kind, e.delta, e.amount0, e.amount1, e.tick_after, CASE WHEN e.kind = 'swap' THEN abs(e.tick_after - lag(e.tick_after) OVER (PARTITION BY b.id, e.kind ORDER BY e.block_number, e.log_index)) END AS step
  FROM events b JOIN events e ON e.pool = b.pool AND (e.block_number, e.log_index) > (b.block_number, b.log_index) AND e.block_number <= b.block_number + {HORIZON} WHERE b.kind = 'burn')""", """SELECT b.id, count(*) FILTER (j.kind = 'swap') AS swaps, count(*) FILTER (j.kind = 'mint') AS mints, count(*) FILTER (j.kind = 'burn') AS burns,
  CAST(coalesce(sum(j.amount0) FILTER (j.amount0 > 0), 0)::HUGEINT AS VARCHAR) AS in0, CAST(coalesce(sum(j.amount1) FILTER (j.amount1 > 0), 0)::HUGEINT AS VARCHAR) AS in1, CAST(coalesce(sum(j.delta), 0)::HUGEINT AS VARCHAR) AS net,
  min(j.tick_after) AS tick_min, max(j.tick_after) AS tick_max, coalesce(sum(step), 0) AS tick_variation FROM events b LEFT JOIN j ON j.id = b.id WHERE b.kind = 'burn' GROUP BY b.id"""),
    "flow_growth": sql(ACTIONS, SWAPS, _STEPS, _WINDOWS, f"g AS ({_GROWTH})", "SELECT measure, horizon, CAST(sum(v)::HUGEINT AS VARCHAR) AS total, count(*) FILTER (less) AS violations FROM g GROUP BY 1, 2"),
    "market_controls": sql(ACTIONS, SNAPSHOTS, MARKET, "SELECT * FROM m"),
    "horizon_changes": sql(ACTIONS, SNAPSHOTS, MARKET, "s AS (SELECT 'all' AS stratum, * FROM m UNION ALL SELECT CASE WHEN active THEN 'active' ELSE 'inactive' END, * FROM m)", f"SELECT stratum, horizon, count(*) AS n, {mean_down_sql('return_bps')} AS mean_return, {mean_down_sql('tick_distance')} AS mean_distance, round(count(*) FILTER (return_bps > 0) / count(*), 9) AS positive_share FROM s GROUP BY 1, 2"),
}
