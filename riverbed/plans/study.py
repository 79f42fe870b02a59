"""Queries of the event study: drawing burns, horizons, flows by horizon, controls, curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riverbed.operators.curves import curve_measures
from riverbed.operators.matching import controls, matched, spaced, stratified_order
from riverbed.operators.ordered import asof, running_totals
from riverbed.operators.stats import smd
from riverbed.plans.base import ACTIONS, IMPACTS, SNAPSHOTS, actions, impacts, snapshots, sql
from riverbed.session import cut

#: Bins, seed and spacing of the drawing; blocks after a burn at which outcomes are read; farthest control.
BINS, SEED, SPACING, HORIZONS, CALIPER = 30, 20260725, 7200, [10, 100, 1000, 7200], 1.25
#: A stratum of matching: the positions of one state of a pool.
STATE = ["pool", "snapshot_index"]
#: Impacts in basis points at which the depth of a curve is read.
THRESHOLDS = [1.0, 10.0, 100.0]


def stratified_burns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All burns of each pool in the order in which they would be drawn."""
    b = actions(spark, sf_dir).where("action_type = 2").select("id", "pool", "block_number", "log_index")
    name = F.concat_ws(":", "pool", "block_number", "log_index")
    return stratified_order(b, "pool", "block_number", name, ["block_number", "log_index", "id"], BINS, SEED).select("id", "bin", "round", "place")


def spaced_burns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of burns at least 7,200 apart in each pool, chosen greedily from the first."""
    return spaced(actions(spark, sf_dir).where("action_type = 2"), "pool", "block_number", SPACING)


def burn_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the pool at each horizon after each burn; horizons beyond the pool's last snapshot are censored."""
    snaps = cut(snapshots(spark, sf_dir).select("pool", "block_number", "tick"))
    head = snaps.groupBy("pool").agg(F.max("block_number").alias("head"))
    b = actions(spark, sf_dir).where("action_type = 2").select("id", "pool", "block_number", F.explode(F.array(*[F.lit(h) for h in HORIZONS])).alias("horizon"))
    due = b.join(head, "pool", "left").withColumn("due", F.col("block_number") + F.col("horizon"))
    at = asof(due.withColumnsRenamed({"block_number": "burn_block", "due": "block_number"}), snaps.withColumn("s", F.struct(F.col("block_number").alias("at"), "tick")), "pool", "block_number", "s")
    seen = F.coalesce(F.col("block_number") <= F.col("head"), F.lit(False)) & F.col("state").isNotNull()
    return at.select("id", "horizon", seen.alias("observed"), F.when(seen, F.col("state.at")).alias("snapshot_block"), F.when(seen, F.col("state.tick")).alias("tick"))


def horizon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed and censored outcomes by horizon; together they are all burns at every horizon."""
    return burn_horizons(spark, sf_dir).groupBy("horizon").agg(F.count("*").alias("expected"), F.count_if("observed").alias("observed"), F.count_if(~F.col("observed")).alias("censored"))


def matched_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A narrow position for each wide one of the same state of its pool, alike in share and distance."""
    i = impacts(spark, sf_dir).where("total IS NOT NULL").withColumn("wide", F.col("range_width") >= 10_000)
    return matched(i, STATE, "impact_id", "wide", ["share", "distance_to_nearest_edge"], CALIPER)


def impact_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact over accumulated share of liquidity, positions nearest to their edge first, per snapshot of a pool."""
    i = impacts(spark, sf_dir).where("share IS NOT NULL AND total IS NOT NULL")
    upto = F.sum("share").over(Window.partitionBy("pool", "snapshot_index").orderBy("distance_to_nearest_edge", "impact_id").rowsBetween(Window.unboundedPreceding, 0))
    worst = F.max("total").over(Window.partitionBy("pool", "snapshot_index").orderBy("distance_to_nearest_edge", "impact_id").rowsBetween(Window.unboundedPreceding, 0))
    points = i.select("pool", "snapshot_index", upto.alias("x"), worst.alias("y"))
    m = curve_measures(points, ["pool", "snapshot_index"], "x", "y", THRESHOLDS)
    return m.select("pool", "snapshot_index", "points", *[F.round(c, 5).alias(c) for c in ("reach", "area", "depth_1", "depth_10", "depth_100")], "breached_1", "breached_10", "breached_100")


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impacts(spark, sf_dir).where("total IS NOT NULL").withColumn("wide", F.col("range_width") >= 10_000)


def controlled_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three narrow positions for each wide one, each used up to three times, and how their impacts differ."""
    i = cut(_wide(spark, sf_dir))
    pairs = controls(i, STATE, "impact_id", "wide", ["share", "distance_to_nearest_edge"], CALIPER)
    total = i.select(F.col("impact_id").cast("string").alias("id"), "total")
    both = pairs.join(total.withColumnsRenamed({"id": "impact_id", "total": "own"}), "impact_id").join(total.withColumnsRenamed({"id": "control", "total": "other"}), "control")
    return both.groupBy("impact_id").agg(F.count("*").alias("controls"), F.max("own").alias("total"), F.avg("other").alias("control_mean"), (F.max("own") - F.avg("other")).alias("excess"))


def matched_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised differences of covariates before and after matching."""
    i = cut(_wide(spark, sf_dir))
    pairs = matched(i, STATE, "impact_id", "wide", ["share", "distance_to_nearest_edge"], CALIPER)
    chosen = pairs.select(F.explode(F.array("impact_id", "control")).alias("id"))
    names = ["share", "distance_to_nearest_edge", "total"]
    long = i.select(F.col("impact_id").cast("string").alias("id"), "wide", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["id", "wide"], names, "covariate", "value")
    before = long.groupBy("covariate").agg(smd(F.col("value"), F.col("wide")).alias("before"))
    after = long.join(chosen, "id", "left_semi").groupBy("covariate").agg(smd(F.col("value"), F.col("wide")).alias("after"))
    return before.join(after, "covariate", "left")


def horizon_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions after all burns by horizon, and how many burns have fewer at a horizon than at the one before (none).

    The actions of a pool are numbered by place, those of one place alike; what lies after a burn is the last number at
    or before its horizon less the burn's own.
    """
    a = cut(actions(spark, sf_dir).select("id", "pool", "block_number", "log_index", "action_type"))
    place = ["pool", "block_number", "log_index"]
    counted = a.where("pool IS NOT NULL AND block_number IS NOT NULL AND log_index IS NOT NULL").groupBy(*place).agg(F.count("*").alias("n"))
    numbered = cut(running_totals(counted, ["pool"], ["block_number", "log_index"], ["n"]).select(*place, F.col("n_upto").alias("upto")))
    burns = a.where("action_type = 2").select("id", *place).join(numbered, place, "left")
    due = burns.select("id", "pool", F.col("upto").alias("own"), "block_number", F.explode(F.array(*[F.lit(h) for h in HORIZONS])).alias("horizon")).withColumn("block_number", F.col("block_number") + F.col("horizon"))
    at = asof(due, numbered, "pool", "block_number", "upto")
    counts = at.select("id", "horizon", F.coalesce(F.col("state") - F.col("own"), F.lit(0)).alias("events"))
    fewer = F.col("events") < F.lag("events").over(Window.partitionBy("id").orderBy("horizon"))
    return counts.withColumn("fewer", fewer).groupBy("horizon").agg(F.count("*").alias("burns"), F.sum("events").alias("events"), F.count_if("fewer").alias("violations"))


QUERIES = {f.__name__: f for f in (stratified_burns, spaced_burns, burn_horizons, horizon_counts, matched_positions, controlled_positions, matched_balance, horizon_flows, impact_curves)}

_HORIZONS = f"""h AS (SELECT b.id, b.pool, horizon, b.block_number + horizon AS block_number FROM actions b, (SELECT unnest({HORIZONS}) AS horizon) WHERE b.action_type = 2),
heads AS (SELECT pool, max(block_number) AS head FROM snaps GROUP BY 1),
o AS (SELECT h.id, h.horizon, coalesce(h.block_number <= head, false) AND s.block_number IS NOT NULL AS observed, s.block_number AS seen, s.tick FROM h LEFT JOIN heads USING (pool) ASOF LEFT JOIN snaps s ON s.pool = h.pool AND h.block_number >= s.block_number)"""
_DEPTH = ", ".join(f"round(coalesce(min(d{t:g}), max(x)), 5) AS depth_{t:g}, min(d{t:g}) IS NOT NULL AS breached_{t:g}" for t in THRESHOLDS)
_STEP = ", ".join(f"CASE WHEN y > {t} AND y0 <= {t} THEN x0 + (x - x0) * ({t} - y0) / (y - y0) END AS d{t:g}" for t in THRESHOLDS)

ORACLE = {
    "stratified_burns": sql(ACTIONS, f"""s AS (SELECT id, pool, block_number, log_index, least({BINS - 1}, ((block_number - min(block_number) OVER (PARTITION BY pool)) * {BINS}) // (max(block_number) OVER (PARTITION BY pool) - min(block_number) OVER (PARTITION BY pool) + 1)) AS bin,
  sha256(unhex('{SEED.to_bytes(8, 'big').hex()}') || encode(pool || ':' || block_number || ':' || log_index)) AS score FROM actions WHERE action_type = 2)""", "r AS (SELECT *, row_number() OVER (PARTITION BY pool, bin ORDER BY score, block_number, log_index, id) AS round FROM s)", "SELECT id, bin, round, row_number() OVER (PARTITION BY pool ORDER BY round, bin) - 1 AS place FROM r"),
    "spaced_burns": sql(ACTIONS, f"""b AS (SELECT DISTINCT pool, block_number FROM actions WHERE action_type = 2),
nexts AS (SELECT b.pool, b.block_number, min(n.block_number) AS following FROM b LEFT JOIN b n ON n.pool = b.pool AND b.block_number + {SPACING} <= n.block_number GROUP BY 1, 2)""", "SELECT pool, block_number FROM (WITH RECURSIVE c AS (SELECT pool, min(block_number) AS block_number FROM b GROUP BY 1 UNION ALL SELECT n.pool, n.following FROM c JOIN nexts n ON n.pool = c.pool AND n.block_number = c.block_number WHERE n.following IS NOT NULL) SELECT * FROM c)"),
    "burn_horizons": sql(ACTIONS, SNAPSHOTS, _HORIZONS, "SELECT id, horizon, observed, CASE WHEN observed THEN seen END AS snapshot_block, CASE WHEN observed THEN tick END AS tick FROM o"),
    "horizon_counts": sql(ACTIONS, SNAPSHOTS, _HORIZONS, "SELECT horizon, count(*) AS expected, count(*) FILTER (observed) AS observed, count(*) FILTER (NOT observed) AS censored FROM o GROUP BY 1"),
    "horizon_flows": sql(ACTIONS, f"""n AS (SELECT b.id, h, count(e.id) AS events FROM actions b CROSS JOIN (SELECT unnest({HORIZONS}) AS h) LEFT JOIN actions e ON e.pool = b.pool AND (e.block_number, e.log_index) > (b.block_number, b.log_index) AND e.block_number <= b.block_number + h WHERE b.action_type = 2 GROUP BY 1, 2)""", "SELECT h AS horizon, count(*) AS burns, CAST(sum(events) AS BIGINT) AS events, 0 AS violations FROM n GROUP BY 1"),
    "impact_curves": sql(IMPACTS, "p AS (SELECT pool, snapshot_index, sum(share) OVER w AS x, max(total) OVER w AS y FROM impacts WHERE share IS NOT NULL AND total IS NOT NULL WINDOW w AS (PARTITION BY pool, snapshot_index ORDER BY distance_to_nearest_edge NULLS FIRST, impact_id ROWS UNBOUNDED PRECEDING))", "q AS (SELECT *, lag(x, 1, 0) OVER w AS x0, lag(y, 1, 0) OVER w AS y0 FROM p WINDOW w AS (PARTITION BY pool, snapshot_index ORDER BY x, y))", f"r AS (SELECT *, {_STEP} FROM q)", f"SELECT pool, snapshot_index, count(*) AS points, round(max(x), 5) AS reach, round(CASE WHEN max(x) > 0 THEN sum((x - x0) * (y + y0) / 2) / max(x) ELSE 0 END, 5) AS area, {_DEPTH} FROM r GROUP BY 1, 2"),
}
