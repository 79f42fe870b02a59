"""Queries over positions: balances, tick maps, coverage, concentration, comparisons of directions."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riverbed.functions.bigint import limbs_needed, sum_limbs, text_of
from riverbed.functions.scalars import location, log1p_of, outside, ratio
from riverbed.operators.ordered import running_totals
from riverbed.operators.stats import pearson
from riverbed.plans.base import ACTIONS, IMPACTS, SNAPSHOTS, actions, impacts, snapshots, sql
from riverbed.plans.depths import GRID, grid_depths
from riverbed.session import cut

#: Positions reported per pool; share of liquidity that a prefix must cover.
TOP, COVER = 20, 0.95
#: The reference's audit of near shares: greatest gap, pairs of a snapshot and in all, logarithm of the ratio to an impact of 0.
NEAR_GAP, NEAR_PAIRS, ALL_PAIRS, ZERO_LOG = 0.10, 25, 500, 12.0


def active_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest positions of each pool that hold its latest tick.

    A missing and an empty owner are grouped apart; both are called unknown.
    """
    now = snapshots(spark, sf_dir).where("tick IS NOT NULL").groupBy("pool").agg(F.max_by("tick", "block_number").alias("tick"), F.max("block_number").alias("through"))
    live = actions(spark, sf_dir).withColumn("owner", F.when(F.col("unnamed"), F.lit("")).otherwise(F.col("owner"))).join(now, "pool").where("block_number <= through AND tick_lower <= tick AND tick < tick_upper")
    held = live.groupBy("pool", "owner", "tick_lower", "tick_upper").agg(F.sum("delta").alias("liquidity")).where("liquidity > 0").withColumn("name", F.coalesce(F.nullif("owner", F.lit("")), F.lit("unknown")))
    place = F.row_number().over(Window.partitionBy("pool").orderBy(F.desc("liquidity"), "name", "tick_lower", "tick_upper", "owner"))
    return held.withColumn("place", place).where(F.col("place") <= TOP).select("pool", "place", F.col("name").alias("owner"), "tick_lower", "tick_upper", F.col("liquidity").cast("string").alias("liquidity"))


def range_liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Liquidity on a burn's exact range before it, and the share of it that the burn removes."""
    a = actions(spark, sf_dir).select("id", "pool", "tick_lower", "tick_upper", "block_number", "log_index", "delta", "action_type")
    upto = running_totals(a, ["pool", "tick_lower", "tick_upper"], ["block_number", "log_index", "id"], ["delta"])
    before = F.col("delta_upto") - F.col("delta")
    return upto.where("action_type = 2").select("id", before.cast("string").alias("before"), F.round(ratio(-F.col("delta"), before), 9).alias("removed"))


def tick_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross and net liquidity on each tick that is an end of a range with liquidity."""
    a = actions(spark, sf_dir)
    ends = F.explode(F.array(F.struct(F.col("tick_lower").alias("tick"), F.col("delta").alias("net")), F.struct(F.col("tick_upper").alias("tick"), (-F.col("delta")).cast("decimal(38,0)").alias("net"))))
    both = a.select("pool", "delta", ends.alias("e")).groupBy("pool", "e.tick").agg(F.sum("delta").alias("gross"), F.sum("e.net").alias("net"))
    return both.where("gross <> 0").select("pool", "tick", F.col("gross").cast("string").alias("gross"), F.col("net").cast("string").alias("net"))


def state_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Liquidity that the actions up to each pool's latest snapshot leave at its tick, beside the recorded one."""
    now = snapshots(spark, sf_dir).where("tick IS NOT NULL").groupBy("pool").agg(F.max_by(F.struct("tick", "active_liquidity"), "block_number").alias("s"), F.max("block_number").alias("through"))
    a = actions(spark, sf_dir).select("pool", "block_number", "tick_lower", "tick_upper", "delta")
    live = (F.col("tick_lower") <= F.col("s.tick")) & (F.col("s.tick") < F.col("tick_upper"))
    both = a.join(now, "pool").where("block_number <= through").groupBy("pool").agg(F.sum(F.when(live, F.col("delta")).otherwise(F.lit(0))).alias("replayed"), F.max("s.active_liquidity").alias("recorded"))
    return both.select("pool", F.col("replayed").cast("string").alias("replayed"), "recorded")


def price_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of big integers beyond any native type, by pool."""
    s = snapshots(spark, sf_dir)
    parts = limbs_needed(s, "sqrt_price_x96")
    a = s.groupBy("pool").agg(*[x.alias(f"l{i}") for i, x in enumerate(sum_limbs(F.col("sqrt_price_x96"), parts))])
    return a.select("pool", text_of([F.col(f"l{i}") for i in range(parts)]).alias("total"))


def coverage_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fewest largest positions of each snapshot that hold 95 % of its listed liquidity."""
    i = impacts(spark, sf_dir).where("liquidity > 0")
    w = Window.partitionBy("pool", "snapshot_index")
    upto = F.sum("liquidity").over(w.orderBy(F.desc("liquidity"), "key").rowsBetween(Window.unboundedPreceding, 0))
    rows = i.withColumns({"upto": upto, "whole": F.sum("liquidity").over(w)})
    target = F.ceil(F.col("whole") * F.lit(int(COVER * 10_000)) / F.lit(10_000))
    rows = rows.withColumn("target", target).where(F.col("upto") - F.col("liquidity") < F.col("target"))
    return rows.groupBy("pool", "snapshot_index").agg(F.count("*").alias("positions"), F.sum("liquidity").cast("string").alias("liquidity"))


def range_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often and how high each position appears over all snapshots."""
    return impacts(spark, sf_dir).groupBy("key").agg(
        F.count("*").alias("appearances"), F.count_if(F.col("total") > 0).alias("felt"), F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block"),
        F.round(F.avg("share"), 9).alias("mean_share"), F.round(F.avg("total"), 6).alias("mean_total"), F.max("total").alias("max_total"),
    )


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, sums over the first by impact, and concentration of impact and of active share, by snapshot."""
    i = impacts(spark, sf_dir).where("total >= 0").select("pool", "snapshot_index", "key", "total", F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(0.0)).alias("share"))
    w = Window.partitionBy("pool", "snapshot_index")
    rows = i.withColumns({"rn": F.row_number().over(w.orderBy(F.desc("total"), "key")), "up": F.row_number().over(w.orderBy("total", "key")), "up_share": F.row_number().over(w.orderBy("share", "key"))})
    n = F.count("*")

    def measures(c: str, up: str) -> tuple[Column, ...]:
        v, whole = F.col(c), F.sum(c)
        first = lambda k: F.sum(F.when(F.col("rn") <= k, v).otherwise(0.0))
        part = lambda x: F.when(whole > 0, x).otherwise(F.lit(0.0))
        squares = F.sum(v * v)
        return whole, first(1), first(3), part(first(1) / whole), part(first(3) / whole), part(squares / (whole * whole)), part((whole * whole) / squares), part(2 * F.sum(v * F.col(up)) / (n * whole) - (n + 1) / n)

    total = dict(zip(("sum_total", "top1_total", "top3_total", "top1", "top3", "hhi", "effective", "gini"), measures("total", "up")))
    share = dict(zip(("sum_share", "top1_share", "top3_share", "", "", "hhi_share", "", "gini_share"), measures("share", "up_share")))
    return rows.groupBy("pool", "snapshot_index").agg(n.alias("positions"), *[c.alias(k) for k, c in {**total, **share}.items() if k])


def snapshot_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _shares(spark, sf_dir)
    return s.select("pool", "snapshot_index", "positions", *[F.round(c, 8).alias(c) for c in ("top1", "top3", "hhi", "effective", "gini")])


#: What is summed up over snapshots: mean impacts of trades in both directions, and the measures of concentration.
SUMMED = ["area_down", "area_up", "sum_share", "top1_share", "top3_share", "sum_total", "top1_total", "top3_total", "top1", "top3", "hhi_share", "hhi", "effective", "gini_share", "gini"]


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, least and greatest of each measure over all snapshots that have it."""
    areas = grid_depths(spark, sf_dir).groupBy("pool", "snapshot_index").agg(F.max(F.when(F.col("zero_for_one"), F.col("area"))).alias("area_down"), F.max(F.when(~F.col("zero_for_one"), F.col("area"))).alias("area_up"))
    both = _shares(spark, sf_dir).join(areas, ["pool", "snapshot_index"], "left")
    long = both.unpivot(["pool", "snapshot_index"], SUMMED, "metric", "value")
    return long.groupBy("metric").agg(F.count("value").alias("snapshots"), *[F.round(f("value"), 6).alias(c) for f, c in ((F.avg, "mean"), (F.min, "least"), (F.max, "greatest"))])


def direction_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of the two directions merged by position; a position may be in one only.

    A direction reports every position that it has an impact of, also one of 0; where it has none, 0 is taken.
    """
    i = cut(impacts(spark, sf_dir).select("pool", "snapshot_index", "key", "zero_for_one", "one_for_zero"))
    on = ["pool", "snapshot_index", "key"]
    down, up = i.where("zero_for_one IS NOT NULL").drop("one_for_zero"), i.where("one_for_zero IS NOT NULL").drop("zero_for_one")
    both = down.join(up, on, "full_outer")
    a, b = F.coalesce("zero_for_one", F.lit(0.0)), F.coalesce("one_for_zero", F.lit(0.0))
    return both.select(*on, F.round(a + b, 9).alias("total"), F.greatest(a, b).alias("largest"))


def near_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of one snapshot whose shares differ by at most 10 %, by how unlike their impacts are.

    A pair needs one impact above 0; where the other is 0 the logarithm of their ratio counts as 12, so these come first.
    Pairs are sought among shares of the same or the next magnitude step only; the best 25 of a snapshot, 500 in all.
    """
    i = impacts(spark, sf_dir).where("share > 0 AND total IS NOT NULL").select("pool", "snapshot_index", "key", "share", "total")
    step = F.floor(F.log("share") / (abs(log(1 - NEAR_GAP)) * (1 + 1e-9)))
    a = i.withColumn("step", step).alias("a")
    b = i.withColumn("step", F.explode(F.array(step - 1, step, step + 1))).alias("b")
    on = (F.col("a.pool") == F.col("b.pool")) & (F.col("a.snapshot_index") == F.col("b.snapshot_index")) & (F.col("a.step") == F.col("b.step")) & (F.col("a.key") < F.col("b.key"))
    gap = F.abs(F.col("a.share") - F.col("b.share")) / F.greatest("a.share", "b.share")
    high, low = F.greatest("a.total", "b.total"), F.least("a.total", "b.total")
    score = F.round(F.when(low > 0, F.log10(high / low)).otherwise(F.lit(ZERO_LOG)) * (1 - gap), 9)
    pairs = a.join(b, on).where((gap <= NEAR_GAP) & (high > 0)).select(F.col("a.pool").alias("pool"), F.col("a.snapshot_index").alias("snapshot_index"), F.col("a.key").alias("key"), F.col("b.key").alias("other"), score.alias("score"))
    best = [F.desc("score"), "key", "other"]
    few = pairs.withColumn("rn", F.row_number().over(Window.partitionBy("pool", "snapshot_index").orderBy(*best))).where(F.col("rn") <= NEAR_PAIRS).drop("rn")
    return few.orderBy(F.desc("score"), "pool", "snapshot_index", "key", "other").limit(ALL_PAIRS)


def direction_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the two directions rank the positions of a snapshot that has at least five."""
    i = impacts(spark, sf_dir).where("zero_for_one IS NOT NULL AND one_for_zero IS NOT NULL")
    w = Window.partitionBy("pool", "snapshot_index")
    at = lambda c: F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy("pool", "snapshot_index", c)) - 1) / 2
    rows = i.withColumns({"ra": at("zero_for_one"), "rb": at("one_for_zero"), "na": F.row_number().over(w.orderBy(F.desc("zero_for_one"), "key")), "nb": F.row_number().over(w.orderBy(F.desc("one_for_zero"), "key"))})
    top = lambda n, k: F.collect_list(F.when(F.col(n) <= k, F.col("key")))
    g = rows.groupBy("pool", "snapshot_index").agg(F.count("*").alias("positions"), F.round(pearson(F.col("ra"), F.col("rb")), 8).alias("rho"), F.size(F.array_intersect(top("na", 1), top("nb", 1))).alias("same_first"), F.size(F.array_intersect(top("na", 3), top("nb", 3))).alias("overlap3"))
    return g.where("positions >= 5")


def pool_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions and impacts by location of the tick and in total."""
    i = impacts(spark, sf_dir).withColumn("location", location(F.col("current_tick"), F.col("tick_lower"), F.col("tick_upper")))
    away = F.count_if(F.col("zero_for_one") > F.col("one_for_zero"))
    g = i.rollup("location").agg(F.grouping("location").alias("g"), F.count("*").alias("positions"), away.alias("down_harder"), F.round(F.avg(log1p_of(F.col("total"))), 8).alias("mean_log"), F.max(outside(F.col("current_tick"), F.col("tick_lower"), F.col("tick_upper"))).alias("farthest"))
    return g.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.coalesce("location", F.lit("none"))).alias("location"), "positions", "down_harder", "mean_log", "farthest")


def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the simulations by pool, one column per outcome."""
    status = F.when(F.col("total").isNull(), "failed").when(F.col("total") == 0, "zero").otherwise("felt")
    g = impacts(spark, sf_dir).withColumn("status", status).groupBy("pool").pivot("status", ["failed", "zero", "felt"]).count()
    return g.select("pool", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("failed", "zero", "felt")])


QUERIES = {f.__name__: f for f in (active_positions, range_liquidity, tick_map, state_parity, price_sums, coverage_prefix, range_aggregates, snapshot_concentration, metric_summary, direction_merge, near_ties, direction_ranks, pool_rollup, status_pivot)}

def _measures(c: str, up: str, names: list[str]) -> str:
    part = lambda x: f"CASE WHEN sum({c}) > 0 THEN {x} ELSE 0 END"
    first = lambda k: f"sum(CASE WHEN rn <= {k} THEN {c} ELSE 0 END)"
    all_ = [f"sum({c})", first(1), first(3), part(f"{first(1)} / sum({c})"), part(f"{first(3)} / sum({c})"), part(f"sum({c} * {c}) / (sum({c}) * sum({c}))"), part(f"(sum({c}) * sum({c})) / sum({c} * {c})"), part(f"2 * sum({c} * {up}) / (count(*) * sum({c})) - (count(*) + 1) / count(*)")]
    return ", ".join(f"{x} AS {n}" for x, n in zip(all_, names) if n)


_SHARES = f"""shares AS (SELECT pool, snapshot_index, count(*) AS positions, {_measures("total", "up", ["sum_total", "top1_total", "top3_total", "top1", "top3", "hhi", "effective", "gini"])}, {_measures("share", "up_share", ["sum_share", "top1_share", "top3_share", "", "", "hhi_share", "", "gini_share"])}
  FROM (SELECT *, row_number() OVER (PARTITION BY pool, snapshot_index ORDER BY total DESC, key) AS rn, row_number() OVER (PARTITION BY pool, snapshot_index ORDER BY total, key) AS up, row_number() OVER (PARTITION BY pool, snapshot_index ORDER BY share, key) AS up_share
    FROM (SELECT pool, snapshot_index, key, total, greatest(coalesce(share, 0), 0) AS share FROM impacts WHERE total >= 0)) GROUP BY 1, 2)"""
_ALL = " UNION ALL ".join(f"SELECT '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM shares LEFT JOIN areas USING (pool, snapshot_index)" for c in SUMMED)
_LOCATED = "CASE WHEN current_tick < tick_lower THEN 'below_current_tick' WHEN current_tick >= tick_upper THEN 'above_current_tick' WHEN current_tick IS NOT NULL THEN 'active' END"
_NOW = "now AS (SELECT pool, max(block_number) AS through, arg_max(tick, block_number) AS tick, arg_max(active_liquidity, block_number) AS recorded FROM snaps WHERE tick IS NOT NULL GROUP BY 1)"

ORACLE = {
    "active_positions": sql(ACTIONS, SNAPSHOTS, _NOW, f"""a AS (SELECT pool, CASE WHEN unnamed THEN '' ELSE owner END AS owner, tick_lower, tick_upper, delta, block_number FROM actions),
h AS (SELECT pool, owner, tick_lower, tick_upper, sum(delta) AS liquidity, coalesce(nullif(owner, ''), 'unknown') AS name FROM a JOIN now USING (pool) WHERE block_number <= through AND tick_lower <= tick AND tick < tick_upper GROUP BY 1, 2, 3, 4 HAVING sum(delta) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY liquidity DESC, name, tick_lower, tick_upper, owner NULLS FIRST) AS place FROM h)""", f"SELECT pool, place, name AS owner, tick_lower, tick_upper, CAST(liquidity::HUGEINT AS VARCHAR) AS liquidity FROM r WHERE place <= {TOP}"),
    "range_liquidity": sql(ACTIONS, "r AS (SELECT *, sum(delta) OVER (PARTITION BY pool, tick_lower, tick_upper ORDER BY block_number, log_index, id ROWS UNBOUNDED PRECEDING) - delta AS before FROM actions)", "SELECT id, CAST(before::HUGEINT AS VARCHAR) AS before, round(CASE WHEN before > 0 THEN CAST(-delta AS DOUBLE) / CAST(before AS DOUBLE) ELSE 0 END, 9) AS removed FROM r WHERE action_type = 2"),
    "tick_map": sql(ACTIONS, "e AS (SELECT pool, tick_lower AS tick, delta, delta AS net FROM actions UNION ALL SELECT pool, tick_upper, delta, -delta FROM actions)", "SELECT pool, tick, CAST(sum(delta)::HUGEINT AS VARCHAR) AS gross, CAST(sum(net)::HUGEINT AS VARCHAR) AS net FROM e GROUP BY 1, 2 HAVING sum(delta) <> 0"),
    "state_parity": sql(ACTIONS, SNAPSHOTS, _NOW, "SELECT pool, CAST(sum(CASE WHEN tick_lower <= tick AND tick < tick_upper THEN delta ELSE 0 END)::HUGEINT AS VARCHAR) AS replayed, max(recorded) AS recorded FROM actions JOIN now USING (pool) WHERE block_number <= through GROUP BY pool"),
    "price_sums": sql(SNAPSHOTS, "SELECT pool, CAST(sum(CAST(sqrt_price_x96 AS HUGEINT))::HUGEINT AS VARCHAR) AS total FROM snaps GROUP BY 1"),
    "coverage_prefix": sql(IMPACTS, f"""r AS (SELECT *, sum(liquidity) OVER (PARTITION BY pool, snapshot_index ORDER BY liquidity DESC, key ROWS UNBOUNDED PRECEDING)::HUGEINT AS upto, sum(liquidity) OVER (PARTITION BY pool, snapshot_index)::HUGEINT AS whole FROM impacts WHERE liquidity > 0)""", f"SELECT pool, snapshot_index, count(*) AS positions, CAST(sum(liquidity)::HUGEINT AS VARCHAR) AS liquidity FROM r WHERE upto - liquidity < (whole * {int(COVER * 10_000)} + 9999) // 10000 GROUP BY 1, 2"),
    "range_aggregates": sql(IMPACTS, "SELECT key, count(*) AS appearances, count(*) FILTER (total > 0) AS felt, min(block_number) AS first_block, max(block_number) AS last_block, round(avg(share), 9) AS mean_share, round(avg(total), 6) AS mean_total, max(total) AS max_total FROM impacts GROUP BY 1"),
    "snapshot_concentration": sql(IMPACTS, _SHARES, "SELECT pool, snapshot_index, positions, round(top1, 8) AS top1, round(top3, 8) AS top3, round(hhi, 8) AS hhi, round(effective, 8) AS effective, round(gini, 8) AS gini FROM shares"),
    "metric_summary": sql(IMPACTS, *GRID, _SHARES, "areas AS (SELECT pool, snapshot_index, max(area) FILTER (zero_for_one) AS area_down, max(area) FILTER (NOT zero_for_one) AS area_up FROM depths GROUP BY 1, 2)", f"l AS ({_ALL})", "SELECT metric, count(value) AS snapshots, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS greatest FROM l GROUP BY 1"),
    "direction_merge": sql(IMPACTS, """SELECT pool, snapshot_index, key, round(coalesce(a.zero_for_one, 0) + coalesce(b.one_for_zero, 0), 9) AS total, greatest(coalesce(a.zero_for_one, 0), coalesce(b.one_for_zero, 0)) AS largest
FROM (SELECT * FROM impacts WHERE zero_for_one IS NOT NULL) a FULL JOIN (SELECT * FROM impacts WHERE one_for_zero IS NOT NULL) b USING (pool, snapshot_index, key)"""),
    "near_ties": sql(IMPACTS, f"""p AS (SELECT a.pool, a.snapshot_index, a.key, b.key AS other, round(CASE WHEN least(a.total, b.total) > 0 THEN log10(greatest(a.total, b.total) / least(a.total, b.total)) ELSE {ZERO_LOG} END * (1 - abs(a.share - b.share) / greatest(a.share, b.share)), 9) AS score
  FROM impacts a JOIN impacts b ON a.pool = b.pool AND a.snapshot_index = b.snapshot_index AND a.key < b.key WHERE a.share > 0 AND b.share > 0 AND greatest(a.total, b.total) > 0 AND a.total IS NOT NULL AND b.total IS NOT NULL AND abs(a.share - b.share) / greatest(a.share, b.share) <= {NEAR_GAP}),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY pool, snapshot_index ORDER BY score DESC, key, other) <= {NEAR_PAIRS})""", f"SELECT * FROM f ORDER BY score DESC, pool, snapshot_index, key, other LIMIT {ALL_PAIRS}"),
    "direction_ranks": sql(IMPACTS, """r AS (SELECT *, rank() OVER (PARTITION BY pool, snapshot_index ORDER BY zero_for_one) + (count(*) OVER (PARTITION BY pool, snapshot_index, zero_for_one) - 1) / 2 AS ra, rank() OVER (PARTITION BY pool, snapshot_index ORDER BY one_for_zero) + (count(*) OVER (PARTITION BY pool, snapshot_index, one_for_zero) - 1) / 2 AS rb,
  row_number() OVER (PARTITION BY pool, snapshot_index ORDER BY zero_for_one DESC, key) AS na, row_number() OVER (PARTITION BY pool, snapshot_index ORDER BY one_for_zero DESC, key) AS nb FROM impacts WHERE zero_for_one IS NOT NULL AND one_for_zero IS NOT NULL)""", """SELECT pool, snapshot_index, count(*) AS positions, round(CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) ELSE 0 END, 8) AS rho, count(*) FILTER (na <= 1 AND nb <= 1) AS same_first, count(*) FILTER (na <= 3 AND nb <= 3) AS overlap3 FROM r GROUP BY 1, 2 HAVING count(*) >= 5"""),
    "pool_rollup": sql(IMPACTS, f"""l AS (SELECT *, {_LOCATED} AS location, CASE WHEN current_tick < tick_lower THEN tick_lower - current_tick WHEN current_tick >= tick_upper THEN current_tick - tick_upper WHEN current_tick IS NOT NULL THEN 0 END AS far FROM impacts)""", """SELECT CASE WHEN grouping(location) = 1 THEN 'TOTAL' ELSE coalesce(location, 'none') END AS location, count(*) AS positions, count(*) FILTER (zero_for_one > one_for_zero) AS down_harder, round(avg(CASE WHEN total > 0 THEN ln(1 + total) ELSE 0 END), 8) AS mean_log, max(far) AS farthest FROM l GROUP BY ROLLUP (location)"""),
    "status_pivot": sql(IMPACTS, "SELECT pool, count(*) FILTER (total IS NULL) AS failed, count(*) FILTER (total = 0) AS zero, count(*) FILTER (total <> 0) AS felt FROM impacts GROUP BY 1"),
}
