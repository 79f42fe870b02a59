"""How much a pool's positions take to move its price, from closed forms that add up over positions.

Between two prices a range holds its liquidity times the difference of square roots of prices, of token 1 when the price
rises, or of their inverses, of token 0 when it falls.  What a trade must pay to a target price is the sum of that over
the positions of the state, so no trade is stepped through: every position meets a fixed list of targets, and a plain
aggregate adds up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.functions.keys import clean_address
from riverbed.operators.curves import curve_measures
from riverbed.plans.base import IMPACTS, address_sql, impacts, sql
from riverbed.session import read

#: Changes of the price, in basis points, whose amounts make the grid of a state.
TARGETS = [1, 5, 10, 25, 50]
STATE = ["pool", "snapshot_index"]


def _root(tick: Column | str) -> Column:
    """Square root of the price at a tick."""
    return F.pow(F.lit(1.0001), F.col(tick).cast("double") / 2)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pool, snapshot_index, key, zero_for_one, target, part, here)``: what a position needs to each target.

    ``here`` is the position's liquidity where its range holds the current tick.  Positions without liquidity or with
    bounds that are null or do not rise, and states without a tick, have no part.
    """
    i = impacts(spark, sf_dir).where("current_tick IS NOT NULL AND liquidity > 0 AND tick_lower < tick_upper").select(*STATE, "key", F.col("liquidity").cast("double").alias("l"), _root("current_tick").alias("p"), _root("tick_lower").alias("a"), _root("tick_upper").alias("b"))
    rows = i.select("*", F.explode(F.array(*[F.struct(F.lit(down).alias("zero_for_one"), F.lit(t).alias("target")) for down in (True, False) for t in TARGETS])).alias("x")).select("*", "x.*")
    factor = F.sqrt(1 + F.when(F.col("zero_for_one"), -F.col("target")).otherwise(F.col("target")) / 10_000)
    end = F.col("p") * factor
    low, high = F.greatest("a", F.least("p", end)), F.least("b", F.greatest("p", end))
    needed = F.when(low < high, F.col("l") * F.when(F.col("zero_for_one"), 1 / low - 1 / high).otherwise(high - low)).otherwise(F.lit(0.0))
    reaches = F.when(F.col("zero_for_one"), F.col("a") <= end).otherwise(F.col("b") >= end)
    here = F.when((F.col("a") <= F.col("p")) & (F.col("p") < F.col("b")), F.col("l")).otherwise(F.lit(0.0))
    return rows.select(*STATE, "key", "zero_for_one", "target", needed.alias("part"), reaches.alias("reaches"), here.alias("here"))


def amount_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a trade must pay, fee included, to move each state's price by 1 to 50 basis points, in both directions.

    Amounts are per unit of active liquidity; null where nothing is active or the pool's fee is unknown, and where no
    position reaches as far as the target.
    """
    fees = read(spark, sf_dir, "pools").groupBy(clean_address("address").alias("pool")).agg(F.min("fee_tier").alias("fee"))
    g = _parts(spark, sf_dir).groupBy(*STATE, "zero_for_one", "target").agg(F.sum("part").alias("amount"), F.max("reaches").alias("reached"), F.sum("here").alias("active"), F.count("*").alias("positions"))
    paid = F.col("amount") / F.col("active") / (1 - F.col("fee") / 1e6)
    return g.join(fees, "pool", "left").select(*STATE, "zero_for_one", "target", "positions", "reached", F.round(F.when(F.col("reached") & (F.col("active") > 0), paid), 9).alias("amount"))


def grid_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean impact and depth at 10 basis points over the grid of each state and direction."""
    grid = amount_grids(spark, sf_dir).where("amount IS NOT NULL")
    m = curve_measures(grid, [*STATE, "zero_for_one"], "amount", "target", [10.0])
    return m.select(*STATE, "zero_for_one", "points", *[F.round(c, 6).alias(c) for c in ("reach", "area", "depth_10")], "breached_10")


def depth_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each state's amounts that one position alone provides, on average over targets, by direction.

    That is by how much trades of a given change of price get smaller without the position.  Null where a state has no
    amount in a direction.
    """
    rows = _parts(spark, sf_dir)
    whole = rows.groupBy(*STATE, "zero_for_one", "target").agg(F.sum("part").alias("whole"))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}")) for c in (*STATE, "zero_for_one", "target")]
    shares = rows.alias("r").join(whole.alias("w"), on).select("r.*", F.when(F.col("whole") > 0, F.col("part") / F.col("whole")).alias("share"))
    return shares.groupBy(*STATE, "key").agg(F.round(F.avg(F.when(F.col("zero_for_one"), F.col("share"))), 9).alias("down"), F.round(F.avg(F.when(~F.col("zero_for_one"), F.col("share"))), 9).alias("up"))


QUERIES = {f.__name__: f for f in (amount_grids, grid_depths, depth_shares)}

_PARTS = f"""i AS (SELECT pool, snapshot_index, key, CAST(liquidity AS DOUBLE) AS l, pow(1.0001::DOUBLE, current_tick::DOUBLE / 2) AS p, pow(1.0001::DOUBLE, tick_lower::DOUBLE / 2) AS a, pow(1.0001::DOUBLE, tick_upper::DOUBLE / 2) AS b FROM impacts WHERE current_tick IS NOT NULL AND liquidity > 0 AND tick_lower < tick_upper),
j AS (SELECT *, p * sqrt(1 + CASE WHEN zero_for_one THEN -target ELSE target END / 10000.0::DOUBLE) AS e FROM i, (SELECT unnest([true, false]) AS zero_for_one), (SELECT unnest({TARGETS}) AS target)),
k AS (SELECT *, greatest(a, least(p, e)) AS lo, least(b, greatest(p, e)) AS hi FROM j),
parts AS (SELECT pool, snapshot_index, key, zero_for_one, target, CASE WHEN lo < hi THEN l * CASE WHEN zero_for_one THEN 1 / lo - 1 / hi ELSE hi - lo END ELSE 0 END AS part, CASE WHEN zero_for_one THEN a <= e ELSE b >= e END AS reaches, CASE WHEN a <= p AND p < b THEN l ELSE 0 END AS here FROM k)"""
_GRID = f"""fees AS (SELECT {address_sql('address')} AS pool, min(fee_tier) AS fee FROM pools GROUP BY 1),
g AS (SELECT pool, snapshot_index, zero_for_one, target, sum(part) AS amount, bool_or(reaches) AS reached, sum(here) AS active, count(*) AS positions FROM parts GROUP BY 1, 2, 3, 4),
grid AS (SELECT pool, snapshot_index, zero_for_one, target, positions, reached, round(CASE WHEN reached AND active > 0 THEN amount / active / (1 - fee / 1e6::DOUBLE) END, 9) AS amount FROM g LEFT JOIN fees USING (pool))"""
_STEPS = """s AS (SELECT *, lag(amount, 1, 0) OVER w AS x0, lag(target::DOUBLE, 1, 0) OVER w AS y0 FROM grid WHERE amount IS NOT NULL WINDOW w AS (PARTITION BY pool, snapshot_index, zero_for_one ORDER BY amount, target)),
d AS (SELECT *, CASE WHEN target > 10 THEN x0 + (amount - x0) * least(1, greatest(0, (10 - y0) / (target - y0))) END AS depth FROM s)"""

_DEPTHS = "depths AS (SELECT pool, snapshot_index, zero_for_one, count(*) AS points, round(max(amount), 6) AS reach, round(CASE WHEN max(amount) > 0 THEN sum((amount - x0) * (target + y0) / 2) / max(amount) ELSE 0 END, 6) AS area, round(coalesce(arg_min(depth, amount) FILTER (depth IS NOT NULL), max(amount)), 6) AS depth_10, count(depth) > 0 AS breached_10 FROM d GROUP BY 1, 2, 3)"
#: Common tables that end in ``depths``, the rows of ``grid_depths``.
GRID = [_PARTS, _GRID, _STEPS, _DEPTHS]

_ALONE = "depth_shares AS (SELECT pool, snapshot_index, key, round(avg(CASE WHEN whole > 0 THEN part / whole END) FILTER (zero_for_one), 9) AS down, round(avg(CASE WHEN whole > 0 THEN part / whole END) FILTER (NOT zero_for_one), 9) AS up FROM (SELECT *, sum(part) OVER (PARTITION BY pool, snapshot_index, zero_for_one, target) AS whole FROM parts) GROUP BY 1, 2, 3)"
#: Common tables that end in ``depth_shares``.
DEPTH_SHARES = [_PARTS, _ALONE]

ORACLE = {
    "amount_grids": sql(IMPACTS, _PARTS, _GRID, "SELECT * FROM grid"),
    "grid_depths": sql(IMPACTS, *GRID, "SELECT * FROM depths"),
    "depth_shares": sql(IMPACTS, *DEPTH_SHARES, "SELECT * FROM depth_shares"),
}
