"""The study's tables: every burn at every horizon, what is missing and why, scenarios of removal, matched pairs of burns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riverbed.functions.exact import mean_down, mean_down_sql
from riverbed.functions.scalars import location, log1p_of, ratio
from riverbed.operators.matching import controls, matched
from riverbed.operators.ordered import asof
from riverbed.operators.stats import holm, interpolated_percentiles, wilcoxon
from riverbed.plans.base import ACTIONS, IMPACTS, SNAPSHOTS, SWAPS, actions, impacts, snapshots, sql
from riverbed.plans.depths import DEPTH_SHARES, depth_shares
from riverbed.plans.events import control_candidates
from riverbed.plans.flows import AMOUNTS, COUNTS, FLOWS, HORIZONS, MARKET, flow_controls, market_controls
from riverbed.plans.study import CALIPER, spaced_burns
from riverbed.session import cut

#: Scenarios: so many of the positions of greatest impact, or the fewest of them that hold so many basis points of active liquidity.
FIRST, PORTIONS = [1, 3, 5], [1000, 2500]
#: Blocks that a burn and its placebo must be apart.
SEPARATION = 7200
KEY = ["id", "horizon"]


def burn_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per burn and horizon: market and flow controls where observed; where not, all of them are null."""
    market = market_controls(spark, sf_dir).withColumn("observed", F.lit(True))
    both = flow_controls(spark, sf_dir).join(market, KEY, "left").withColumn("observed", F.coalesce("observed", F.lit(False)))
    told = [c for c in both.columns if c not in (*KEY, "observed")]
    return both.select(*KEY, "observed", *[F.when(F.col("observed"), F.col(c)).alias(c) for c in told])


def burn_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flows of every observed burn and horizon once per direction of trade, in one column each."""
    side = lambda way, n, into, out: F.struct(F.lit(way).alias("direction"), F.col(n).alias("trades"), F.col(into).alias("paid"), F.col(out).alias("got"))
    rows = burn_dataset(spark, sf_dir).where("observed")
    return rows.select(*KEY, F.explode(F.array(side("zero_for_one", "zero_for_one", "in0", "out1"), side("one_for_zero", "one_for_zero", "in1", "out0"))).alias("s")).select(*KEY, "s.*")


def missing_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burns and horizons without an outcome, with the reason: no pool, no state before the burn, or beyond the last state."""
    snaps = snapshots(spark, sf_dir).where("tick IS NOT NULL").groupBy("pool").agg(F.min("block_number").alias("lo"), F.max("block_number").alias("hi"))
    b = actions(spark, sf_dir).where("action_type = 2").select("id", "pool", "block_number").join(snaps, "pool", "left")
    rows = b.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in HORIZONS])))
    why = F.when(F.col("pool").isNull(), "no_pool").when(F.col("lo").isNull() | (F.col("block_number") < F.col("lo")), "no_state_before").when(F.col("block_number") + F.col("horizon") > F.col("hi"), "beyond_last_state")
    return rows.select(*KEY, why.alias("reason")).where("reason IS NOT NULL")


def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and means by horizon, over all burns and by pool; observed and missing are together what is expected."""
    pools = actions(spark, sf_dir).where("action_type = 2").select("id", F.coalesce("pool", F.lit("none")).alias("pool"))
    d = burn_dataset(spark, sf_dir).select(*KEY, "observed", "return_bps", "tick_distance", "swaps").join(pools, "id").withColumn("pool", F.explode(F.array(F.lit("all"), "pool")))
    r = F.col("return_bps")
    return d.groupBy("pool", "horizon").agg(
        F.count("*").alias("expected"), F.count_if("observed").alias("observed"), F.count_if(~F.col("observed")).alias("missing"), F.round(F.count_if("observed") * 100 / F.count("*"), 6).alias("observed_percent"),
        F.count_if(r > 0).alias("positive"), F.count_if(r <= 0).alias("not_positive"), mean_down(r).alias("mean_return"), F.round(F.max(F.abs(r)), 6).alias("largest_return"), F.round(F.avg("swaps"), 6).alias("mean_swaps"),
    )


def burn_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a burn can enter the study: all horizons observed, and its pool's burn before it is farther than the longest."""
    observed = market_controls(spark, sf_dir).groupBy("id").agg(F.array_sort(F.collect_set("horizon")).alias("horizons"))
    blocks = actions(spark, sf_dir).where("action_type = 2 AND pool IS NOT NULL").select("id", "pool", "block_number")
    last = blocks.select("pool", (F.col("block_number") + 1).alias("block_number"), F.col("block_number").alias("last"))
    b = asof(blocks, last, "pool", "block_number", "last", out="before").join(observed, "id", "left")
    whole, apart = F.coalesce(F.size("horizons") == len(HORIZONS), F.lit(False)), F.coalesce(F.col("block_number") - F.col("before") > max(HORIZONS), F.lit(True))
    return b.select("id", F.coalesce(F.array_join("horizons", ","), F.lit("")).alias("horizons"), (F.col("block_number") - F.col("before")).alias("gap"), whole.alias("whole"), apart.alias("apart"), (whole & apart).alias("ready"))


def removal_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the positions of greatest impact hold together, by scenario and state, and the depth that goes with them.

    ``reached`` is false where a state has fewer positions, or less liquidity around its tick, than the scenario takes.
    """
    i = impacts(spark, sf_dir).where("total IS NOT NULL AND liquidity > 0").select("pool", "snapshot_index", "key", "total", "liquidity", (location(F.col("current_tick"), F.col("tick_lower"), F.col("tick_upper")) == "active").alias("active"))
    w = Window.partitionBy("pool", "snapshot_index")
    by = w.orderBy(F.desc("total"), "key")
    held = F.when(F.col("active"), F.col("liquidity")).otherwise(F.lit(0)).cast("decimal(38,0)")
    rows = i.withColumns({"place": F.row_number().over(by), "held": held}).withColumns({"upto": F.sum("held").over(by.rowsBetween(Window.unboundedPreceding, 0)), "whole": F.sum("held").over(w), "n": F.count("*").over(w)})
    first = [F.struct(F.lit(f"first_{k}").alias("scenario"), (F.col("place") <= k).alias("in"), (F.col("n") >= k).alias("reached")) for k in FIRST]
    target = lambda bps: F.ceil(F.col("whole") * F.lit(bps) / F.lit(10_000))
    part = [F.struct(F.lit(f"share_{bps}").alias("scenario"), (F.col("upto") - F.col("held") < target(bps)).alias("in"), (F.col("whole") > 0).alias("reached")) for bps in PORTIONS]
    taken = rows.withColumn("s", F.explode(F.array(*first, *part))).where("s.in").select("pool", "snapshot_index", "key", "held", "whole", "s.scenario", "s.reached")
    depth = depth_shares(spark, sf_dir).select(F.col("pool").alias("p"), F.col("snapshot_index").alias("x"), F.col("key").alias("k"), "down", "up")
    same = F.col("pool").eqNullSafe(F.col("p")) & F.col("snapshot_index").eqNullSafe(F.col("x")) & F.col("key").eqNullSafe(F.col("k"))
    g = taken.join(depth, same, "left").groupBy("pool", "snapshot_index", "scenario").agg(F.count("*").alias("positions"), F.sum("held").alias("liquidity"), F.max("whole").alias("whole"), F.max("reached").alias("reached"), F.round(F.sum("down"), 9).alias("down"), F.round(F.sum("up"), 9).alias("up"))
    return g.select("pool", "snapshot_index", "scenario", "positions", F.col("liquidity").cast("string").alias("liquidity"), F.round(ratio(F.col("liquidity"), F.col("whole")), 9).alias("share"), "reached", "down", "up")


def scenario_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and median share of each scenario over the states that reach it."""
    s = cut(removal_scenarios(spark, sf_dir).where("reached").select("scenario", "positions", "share"))
    means = s.groupBy("scenario").agg(F.count("*").alias("states"), F.round(F.avg("positions"), 6).alias("mean_positions"), F.round(F.avg("share"), 6).alias("mean_share"))
    return means.join(interpolated_percentiles(s, "scenario", "share", [0.5]).select("scenario", F.round("q0", 6).alias("median_share")), "scenario")


def _spaced_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One burn at each spaced block, the first of the block, with the state before it and what it takes of it."""
    blocks = spaced_burns(spark, sf_dir)
    b = actions(spark, sf_dir).where("action_type = 2 AND delta < 0").join(blocks, ["pool", "block_number"])
    first = b.groupBy("pool", "block_number").agg(F.min(F.struct("log_index", "id", "tick_lower", "tick_upper", "delta")).alias("b")).select("pool", "block_number", "b.*")
    snaps = snapshots(spark, sf_dir).where("tick IS NOT NULL").select("pool", "block_number", F.struct("block_number", "tick", "active_liquidity").alias("s"))
    at = asof(first, snaps, "pool", "block_number", "s", out="was").where("was IS NOT NULL")
    active, gone = F.col("was.active_liquidity").cast("double"), -F.col("delta").cast("double")
    return at.select("id", "pool", "block_number", "log_index", location(F.col("was.tick"), F.col("tick_lower"), F.col("tick_upper")).alias("location"), F.col("was.tick").alias("tick"), log1p_of(active).alias("log_active"), log1p_of(gone).alias("log_removed"), ratio(gone, active).alias("fraction"), (F.col("tick_upper") - F.col("tick_lower")).alias("width"))


def paired_burns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burns of a large part of the active liquidity, each with one of a small part in the same pool and location.

    Burns are those at spaced blocks, so a pool has no more of them than its blocks hold spacings.  Of each pool and
    location the upper half by the removed fraction is paired with the lower half; a middle one stays out.  Alike are
    burns with near blocks, ticks, liquidity, removed liquidity (which counts double) and widths.
    """
    s = cut(_spaced_states(spark, sf_dir))
    w = Window.partitionBy("pool", "location")
    rows = s.withColumns({"n": F.count("*").over(w), "place": F.row_number().over(w.orderBy("fraction", "block_number", "log_index"))})
    halves = rows.withColumn("high", F.col("place") > F.col("n") - F.floor(F.col("n") / 2)).where(F.col("high") | (F.col("place") <= F.floor(F.col("n") / 2)))
    pairs = matched(halves, ["pool", "location"], "id", "high", ["block_number", "tick", "log_active", "log_removed", "log_removed", "width"], float("inf"))
    return pairs.join(s.select("id", "pool", "location"), "id").select(F.col("id").alias("high"), F.col("control").alias("low"), "pool", "location", "distance")


def pair_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both burns of each pair at each horizon that both are observed at, and how much farther the price went after the high one."""
    pairs, market = cut(paired_burns(spark, sf_dir)), cut(market_controls(spark, sf_dir).select(*KEY, "return_size_bps", "tick_distance"))
    swaps = flow_controls(spark, sf_dir).select(*KEY, "swaps")
    one = lambda side: market.select(F.col("id").alias(side), "horizon", F.col("return_size_bps").alias(f"{side}_return"), F.col("tick_distance").alias(f"{side}_distance"))
    both = pairs.join(one("high"), "high").join(one("low"), ["low", "horizon"])
    flows = both.join(swaps.withColumnsRenamed({"id": "high", "swaps": "high_swaps"}), ["high", "horizon"], "left")
    return flows.select("high", "low", "pool", "location", "horizon", (F.col("high_return") - F.col("low_return")).alias("return_gap"), (F.col("high_distance") - F.col("low_distance")).alias("distance_gap"), "high_swaps")


def pair_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median, share above 0 and signed-rank test of the gap of returns, for all pairs and by location, by horizon.

    p-values are adjusted over the horizons of a stratum.
    """
    rows = pair_outcomes(spark, sf_dir).select(F.explode(F.array(F.lit("all"), "location")).alias("stratum"), "horizon", F.round("return_gap", 6).alias("gap"))
    rows = cut(rows.select(F.concat_ws("|", "stratum", "horizon").alias("cell"), "gap"))
    means = rows.groupBy("cell").agg(F.round(F.avg("gap"), 6).alias("mean"), F.round(F.count_if(F.col("gap") > 0) / F.count("*"), 9).alias("positive_share"))
    medians = interpolated_percentiles(rows, "cell", "gap", [0.5]).select("cell", "n", F.round("q0", 6).alias("median"))
    tests = wilcoxon(rows, "cell", "gap").select("cell", "z", "p")
    both = means.join(medians, "cell").join(tests, "cell", "left").select(F.split("cell", "[|]")[0].alias("stratum"), F.split("cell", "[|]")[1].cast("int").alias("horizon"), "n", "mean", "median", "positive_share", F.coalesce("z", F.lit(0.0)).alias("z"), F.coalesce("p", F.lit(1.0)).alias("p"))
    return holm(both, ["stratum"], "p", ["horizon"])


def placebo_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each spaced burn up to three blocks of its pool without liquidity actions nearby at which its state was alike.

    A block serves up to three burns, lies at least ``SEPARATION`` blocks from them, and within the caliper in block, tick
    and active liquidity.  Of a pool there are no more candidates than its blocks hold strides.
    """
    snaps = snapshots(spark, sf_dir).where("tick IS NOT NULL").select("pool", "block_number", F.struct("tick", "active_liquidity").alias("s"))
    quiet = asof(control_candidates(spark, sf_dir), snaps, "pool", "block_number", "s", out="was").where("was IS NOT NULL")
    free = quiet.select(F.concat_ws(":", "pool", "block_number").alias("name"), "pool", "block_number", F.col("was.tick").alias("tick"), log1p_of(F.col("was.active_liquidity").cast("double")).alias("log_active"), F.lit(False).alias("burn"))
    burns = _spaced_states(spark, sf_dir).select(F.col("id").alias("name"), "pool", "block_number", "tick", "log_active", F.lit(True).alias("burn"))
    found = controls(burns.unionByName(free), ["pool"], "name", "burn", ["block_number", "tick", "log_active"], CALIPER, apart=("block_number", SEPARATION))
    at = F.split("control", ":")
    return found.select(F.col("name").alias("id"), at[0].alias("pool"), at[1].cast("long").alias("control_block"), "choice", "distance")


def placebo_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far tick and price went after each burn, and on average after its placebos, by horizon.

    Only placebos whose horizon the pool's states reach count; burns without any are left out.
    """
    snaps = cut(snapshots(spark, sf_dir).where("tick IS NOT NULL").select("pool", "block_number", F.struct("tick", F.col("sqrt_price_x96").alias("price")).alias("s")))
    head = snaps.groupBy("pool").agg(F.max("block_number").alias("head"))
    m = cut(placebo_matches(spark, sf_dir))
    blocks = m.select("pool", F.col("control_block").alias("block_number")).distinct()
    was = asof(blocks, snaps, "pool", "block_number", "s", out="was").withColumnRenamed("block_number", "control_block")
    due = was.join(head, "pool").withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in HORIZONS]))).withColumn("block_number", F.col("control_block") + F.col("horizon")).where("block_number <= head")
    now = asof(due, snaps, "pool", "block_number", "s", out="now")
    size = F.abs(F.pow(F.col("now.price").cast("double") / F.col("was.price").cast("double"), F.lit(2.0)) - 1) * 10_000
    after = now.select("pool", "control_block", "horizon", size.alias("return"), F.abs(F.col("now.tick") - F.col("was.tick")).alias("distance"))
    placebo = m.drop("distance").join(after, ["pool", "control_block"]).groupBy(*KEY).agg(F.count("*").alias("placebos"), F.avg("return").alias("placebo_return"), F.avg("distance").alias("placebo_distance"))
    own = market_controls(spark, sf_dir).select(*KEY, "return_size_bps", "tick_distance")
    return own.join(placebo, KEY).select(*KEY, "placebos", "return_size_bps", F.round("placebo_return", 6).alias("placebo_return"), F.round(F.col("return_size_bps") - F.col("placebo_return"), 6).alias("excess_return"), (F.col("tick_distance") - F.col("placebo_distance")).alias("excess_distance"))


def placebo_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, mean and median of the excess over placebos and its signed-rank test, by horizon."""
    o = cut(placebo_outcomes(spark, sf_dir).select(F.col("horizon").cast("string").alias("horizon"), "excess_return"))
    g = o.groupBy("horizon").agg(F.round(F.avg("excess_return"), 6).alias("mean"), F.round(F.count_if(F.col("excess_return") > 0) / F.count("*"), 9).alias("positive_share"))
    median = interpolated_percentiles(o, "horizon", "excess_return", [0.5]).select("horizon", "n", F.round("q0", 6).alias("median"))
    t = wilcoxon(o, "horizon", "excess_return").select("horizon", "z", "p")
    return holm(g.join(median, "horizon").join(t, "horizon", "left").withColumn("family", F.lit("placebo")), ["family"], "p", ["horizon"]).drop("family")


QUERIES = {f.__name__: f for f in (burn_dataset, burn_directions, missing_outcomes, dataset_summary, burn_readiness, removal_scenarios, scenario_summary, paired_burns, pair_outcomes, pair_statistics, placebo_matches, placebo_outcomes, placebo_statistics)}

_MARKET_COLUMNS = ["tick_change", "tick_distance", "return_bps", "return_size_bps", "location", "active", "liquidity_change", "change_fraction"]
_FLOW_COLUMNS = [*COUNTS, *AMOUNTS, "volume0", "volume1", "net", "tick_start", "tick_end", "tick_min", "tick_max", "tick_range", "tick_variation", "tick_squares", "tick_step_max"]
_DATASET = [ACTIONS, SWAPS, SNAPSHOTS, *FLOWS, MARKET, "dataset AS (SELECT f.id, f.horizon, m.id IS NOT NULL AS observed, " + ", ".join(f"CASE WHEN m.id IS NOT NULL THEN f.{c} END AS {c}" for c in _FLOW_COLUMNS) + ", " + ", ".join(f"m.{c}" for c in _MARKET_COLUMNS) + " FROM flows f LEFT JOIN m ON m.id = f.id AND m.horizon = f.horizon)"]
_SCENARIOS = f"""pos AS (SELECT *, CASE WHEN current_tick >= tick_lower AND current_tick < tick_upper THEN liquidity ELSE 0 END AS held FROM impacts WHERE total IS NOT NULL AND liquidity > 0),
placed AS (SELECT *, row_number() OVER w AS place, (sum(held) OVER w)::HUGEINT AS upto, (sum(held) OVER s)::HUGEINT AS whole, count(*) OVER s AS n FROM pos WINDOW s AS (PARTITION BY pool, snapshot_index), w AS (PARTITION BY pool, snapshot_index ORDER BY total DESC, key ROWS UNBOUNDED PRECEDING)),
taken AS ({" UNION ALL ".join([f"SELECT pool, snapshot_index, key, held, whole, 'first_{k}' AS scenario, n >= {k} AS reached FROM placed WHERE place <= {k}" for k in FIRST] + [f"SELECT pool, snapshot_index, key, held, whole, 'share_{b}', whole > 0 FROM placed WHERE upto - held < (whole * {b} + 9999) // 10000" for b in PORTIONS])}),
scenarios AS (SELECT t.pool, t.snapshot_index, scenario, count(*) AS positions, CAST(sum(held)::HUGEINT AS VARCHAR) AS liquidity, round(CASE WHEN max(whole) > 0 THEN CAST(sum(held) AS DOUBLE) / CAST(max(whole) AS DOUBLE) ELSE 0 END, 9) AS share, bool_or(reached) AS reached, round(sum(down), 9) AS down, round(sum(up), 9) AS up
  FROM taken t LEFT JOIN depth_shares d ON d.pool IS NOT DISTINCT FROM t.pool AND d.snapshot_index = t.snapshot_index AND d.key IS NOT DISTINCT FROM t.key GROUP BY 1, 2, 3)"""

ORACLE = {
    "burn_dataset": sql(*_DATASET, "SELECT * FROM dataset"),
    "burn_directions": sql(*_DATASET, "SELECT id, horizon, 'zero_for_one' AS direction, zero_for_one AS trades, in0 AS paid, out1 AS got FROM dataset WHERE observed UNION ALL SELECT id, horizon, 'one_for_zero', one_for_zero, in1, out0 FROM dataset WHERE observed"),
    "missing_outcomes": sql(ACTIONS, SNAPSHOTS, "r AS (SELECT pool, min(block_number) AS lo, max(block_number) AS hi FROM snaps WHERE tick IS NOT NULL GROUP BY 1)", f"w AS (SELECT id, horizon, CASE WHEN pool IS NULL THEN 'no_pool' WHEN lo IS NULL OR block_number < lo THEN 'no_state_before' WHEN block_number + horizon > hi THEN 'beyond_last_state' END AS reason FROM actions LEFT JOIN r USING (pool), (SELECT unnest({HORIZONS}) AS horizon) WHERE action_type = 2)", "SELECT * FROM w WHERE reason IS NOT NULL"),
    "dataset_summary": sql(*_DATASET, "p AS (SELECT d.*, unnest(['all', coalesce(a.pool, 'none')]) AS pool FROM dataset d JOIN (SELECT id, pool FROM actions WHERE action_type = 2) a USING (id))", f"""SELECT pool, horizon, count(*) AS expected, count(*) FILTER (observed) AS observed, count(*) FILTER (NOT observed) AS missing, round(count(*) FILTER (observed) * 100 / count(*), 6) AS observed_percent,
  count(*) FILTER (return_bps > 0) AS positive, count(*) FILTER (return_bps <= 0) AS not_positive, {mean_down_sql("return_bps")} AS mean_return, round(max(abs(return_bps)), 6) AS largest_return, round(avg(swaps), 6) AS mean_swaps FROM p GROUP BY 1, 2"""),
    "burn_readiness": sql(ACTIONS, SNAPSHOTS, MARKET, "o AS (SELECT id, string_agg(horizon, ',' ORDER BY horizon) AS horizons, count(*) AS n FROM m GROUP BY 1)", "b AS (SELECT id, pool, block_number FROM actions WHERE action_type = 2 AND pool IS NOT NULL)", "g AS (SELECT b.id, b.block_number - max(x.block_number) AS gap FROM b LEFT JOIN (SELECT DISTINCT pool, block_number FROM b) x ON x.pool = b.pool AND x.block_number < b.block_number GROUP BY b.id, b.block_number)", f"SELECT id, coalesce(horizons, '') AS horizons, gap, coalesce(n, 0) = {len(HORIZONS)} AS whole, coalesce(gap > {max(HORIZONS)}, true) AS apart, coalesce(n, 0) = {len(HORIZONS)} AND coalesce(gap > {max(HORIZONS)}, true) AS ready FROM g LEFT JOIN o USING (id)"),
    "removal_scenarios": sql(IMPACTS, *DEPTH_SHARES, _SCENARIOS, "SELECT * FROM scenarios"),
    "scenario_summary": sql(IMPACTS, *DEPTH_SHARES, _SCENARIOS, "SELECT scenario, count(*) AS states, round(avg(positions), 6) AS mean_positions, round(avg(share), 6) AS mean_share, round(quantile_cont(share, 0.5), 6) AS median_share FROM scenarios WHERE reached GROUP BY 1"),
}
