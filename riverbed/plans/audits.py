"""Audits of what is built from the events, scans by cursor, pages of every feed, and ranks of positions by snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riverbed.operators.chunks import number_rows
from riverbed.operators.stats import interpolated_percentiles, pearson
from riverbed.plans.base import ACTIONS, IMPACTS, SNAPSHOTS, SWAPS, actions, impacts, snapshots, sql, swaps
from riverbed.plans.events import EVENTS, PAGE
from riverbed.session import cut

STATE = ["pool", "snapshot_index"]
#: Positions that a snapshot needs for a correlation.
LEAST = 5


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = actions(spark, sf_dir).select("pool", "block_number", "log_index", F.when(F.col("action_type") == 1, "mint").otherwise("burn").alias("kind"), "id")
    return a.unionByName(swaps(spark, sf_dir).select("pool", "block_number", "log_index", F.lit("swap").alias("kind"), "id"))


def tick_map_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pool: ticks that end a range, those with less than no liquidity, those with a net but no gross, and the sum of nets (0)."""
    end = lambda t, sign: F.struct(F.col(t).alias("tick"), (F.col("delta") * sign).cast("decimal(38,0)").alias("net"))
    ticks = actions(spark, sf_dir).select("pool", "delta", F.explode(F.array(end("tick_lower", 1), end("tick_upper", -1))).alias("e")).groupBy("pool", "e.tick").agg(F.sum("delta").alias("gross"), F.sum("e.net").alias("net"))
    return ticks.groupBy("pool").agg(F.count("*").alias("ticks"), F.count_if(F.col("gross") < 0).alias("negative"), F.count_if((F.col("gross") == 0) & (F.col("net") != 0)).alias("unbalanced"), F.sum("net").cast("string").alias("net_sum"))


def shared_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the chain of a pool that more than one event claims, with the kinds of events."""
    g = _events(spark, sf_dir).groupBy("pool", "block_number", "log_index").agg(F.count("*").alias("events"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return g.where("events > 1")


def burn_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the same pool and block before each burn that changes liquidity; a block holds few."""
    b = actions(spark, sf_dir).where("action_type = 2 AND delta <> 0").select("id", "pool", "block_number", F.col("log_index").alias("at"))
    e = _events(spark, sf_dir).withColumnRenamed("id", "earlier")
    return b.join(e, ["pool", "block_number"]).where("log_index < at").select("id", "earlier", "kind", "log_index")


def covered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each pool after its first state and up to its last, by kind, and whether each has a place of its own."""
    span = snapshots(spark, sf_dir).groupBy("pool").agg(F.min("block_number").alias("after"), F.max("block_number").alias("through"))
    e = _events(spark, sf_dir).join(span, "pool").where("block_number > after AND block_number <= through")
    places = e.groupBy("pool", "kind", "block_number", "log_index").agg(F.count("*").alias("n"))
    return places.groupBy("pool", "kind").agg(F.sum("n").alias("events"), (F.max("n") == 1).alias("strict"))


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 1,000 of every feed of a pool in the order of the chain, with their first and last places."""
    e = _events(spark, sf_dir).withColumn("feed", F.struct("kind", "pool"))
    paged = number_rows(e, "feed", ["block_number", "log_index", "id"]).withColumn("page", F.floor(F.col("row_in_key") / PAGE))
    place = F.struct("block_number", "log_index")
    g = paged.groupBy("kind", "pool", "page").agg(F.count("*").alias("rows"), F.min(place).alias("a"), F.max(place).alias("z"))
    return g.select("kind", "pool", "page", "rows", F.col("a.block_number").alias("first_block"), F.col("a.log_index").alias("first_log"), F.col("z.block_number").alias("last_block"), F.col("z.log_index").alias("last_log"))


def position_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each position ranks by impact among those of its snapshots: times first, best, mean and worst rank."""
    i = impacts(spark, sf_dir).where("total IS NOT NULL")
    place = F.row_number().over(Window.partitionBy(*STATE).orderBy(F.desc("total"), "key"))
    return i.withColumn("place", place).groupBy("key").agg(F.count("*").alias("ranked"), F.count_if(F.col("place") == 1).alias("first"), F.min("place").alias("best"), F.round(F.avg("place"), 6).alias("mean"), F.max("place").alias("worst"))


def _correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per snapshot Spearman's correlation of share and impact, where it has five positions and two values of each."""
    i = impacts(spark, sf_dir).where("share IS NOT NULL AND total IS NOT NULL")
    w = Window.partitionBy(*STATE)
    at = lambda c: F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*STATE, c)) - 1) / 2
    g = i.withColumns({"a": at("share"), "b": at("total")}).groupBy(*STATE).agg(F.count("*").alias("n"), F.countDistinct("share").alias("x"), F.countDistinct("total").alias("y"), pearson(F.col("a"), F.col("b")).alias("rho"))
    return g.where(f"n >= {LEAST} AND x >= 2 AND y >= 2").select(*STATE, "n", F.round("rho", 8).alias("rho"))


def snapshot_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median and least correlation of share and impact over the snapshots of each pool that have one."""
    c = cut(_correlations(spark, sf_dir))
    g = c.groupBy("pool").agg(F.count("*").alias("snapshots"), F.round(F.avg("rho"), 6).alias("mean"), F.round(F.min("rho"), 6).alias("least"))
    return g.join(interpolated_percentiles(c, "pool", "rho", [0.5]).select("pool", F.round("q0", 6).alias("median")), "pool")


QUERIES = {f.__name__: f for f in (tick_map_audit, shared_places, burn_prefixes, covered_events, event_pages, position_ranks, snapshot_correlations)}

ORACLE = {
    "tick_map_audit": sql(ACTIONS, "e AS (SELECT pool, tick_lower AS tick, delta, delta AS net FROM actions UNION ALL SELECT pool, tick_upper, delta, -delta FROM actions)", "t AS (SELECT pool, tick, sum(delta) AS gross, sum(net)::HUGEINT AS net FROM e GROUP BY 1, 2)", "SELECT pool, count(*) AS ticks, count(*) FILTER (gross < 0) AS negative, count(*) FILTER (gross = 0 AND net <> 0) AS unbalanced, CAST(sum(net)::HUGEINT AS VARCHAR) AS net_sum FROM t GROUP BY 1"),
    "shared_places": sql(ACTIONS, SWAPS, EVENTS, "SELECT pool, block_number, log_index, count(*) AS events, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM events GROUP BY 1, 2, 3 HAVING count(*) > 1"),
    "burn_prefixes": sql(ACTIONS, SWAPS, EVENTS, "SELECT b.id, e.id AS earlier, e.kind, e.log_index FROM events b JOIN events e ON e.pool = b.pool AND e.block_number = b.block_number AND e.log_index < b.log_index WHERE b.kind = 'burn' AND b.delta <> 0"),
    "covered_events": sql(ACTIONS, SWAPS, SNAPSHOTS, EVENTS, "s AS (SELECT pool, min(block_number) AS lo, max(block_number) AS hi FROM snaps GROUP BY 1)", "SELECT pool, kind, count(*) AS events, count(*) = count(DISTINCT (block_number, log_index)) AS strict FROM events JOIN s USING (pool) WHERE block_number > lo AND block_number <= hi GROUP BY 1, 2"),
    "event_pages": sql(ACTIONS, SWAPS, EVENTS, f"n AS (SELECT *, (row_number() OVER (PARTITION BY kind, pool ORDER BY block_number, log_index, id) - 1) // {PAGE} AS page FROM events)", "SELECT kind, pool, page, count(*) AS rows, arg_min(block_number, (block_number, log_index)) AS first_block, arg_min(log_index, (block_number, log_index)) AS first_log, arg_max(block_number, (block_number, log_index)) AS last_block, arg_max(log_index, (block_number, log_index)) AS last_log FROM n GROUP BY 1, 2, 3"),
    "position_ranks": sql(IMPACTS, "r AS (SELECT key, row_number() OVER (PARTITION BY pool, snapshot_index ORDER BY total DESC, key) AS place FROM impacts WHERE total IS NOT NULL)", "SELECT key, count(*) AS ranked, count(*) FILTER (place = 1) AS first, min(place) AS best, round(avg(place), 6) AS mean, max(place) AS worst FROM r GROUP BY 1"),
    "snapshot_correlations": sql(IMPACTS, "r AS (SELECT pool, snapshot_index, share, total, rank() OVER (PARTITION BY pool, snapshot_index ORDER BY share) + (count(*) OVER (PARTITION BY pool, snapshot_index, share) - 1) / 2 AS a, rank() OVER (PARTITION BY pool, snapshot_index ORDER BY total) + (count(*) OVER (PARTITION BY pool, snapshot_index, total) - 1) / 2 AS b FROM impacts WHERE share IS NOT NULL AND total IS NOT NULL)", f"c AS (SELECT pool, snapshot_index, round(CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) ELSE 0 END, 8) AS rho FROM r GROUP BY 1, 2 HAVING count(*) >= {LEAST} AND count(DISTINCT share) >= 2 AND count(DISTINCT total) >= 2)", "SELECT pool, count(*) AS snapshots, round(avg(rho), 6) AS mean, round(min(rho), 6) AS least, round(quantile_cont(rho, 0.5), 6) AS median FROM c GROUP BY 1"),
}
