"""Queries for statistics per pool: correlations, percentiles, balance, tests, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.functions.scalars import location
from riverbed.operators.stats import average_ranks, bootstrap_mean, concentration, holm, interpolated_percentiles, pearson, percentile_of_value, sign_flip, smd, spearman, wilcoxon
from riverbed.plans.base import IMPACTS, impacts, sql
from riverbed.session import cut

#: Replicates of the bootstrap and of the test by random signs, as in the reference.
DRAWS = 20_000
METRICS = ["share", "range_width", "distance_to_lower_tick", "distance_to_upper_tick", "distance_to_nearest_edge", "density"]
TARGETS = ["zero_for_one", "one_for_zero", "total", "largest"]


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = impacts(spark, sf_dir)
    return i.withColumn("location", F.coalesce(location(F.col("current_tick"), F.col("tick_lower"), F.col("tick_upper")), F.lit("none")))


def share_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson's and Spearman's correlation of share and total impact by pool."""
    i = cut(impacts(spark, sf_dir).select("pool", "share", "total"))
    p = i.where("share IS NOT NULL AND total IS NOT NULL").groupBy("pool").agg(F.round(pearson(F.col("share"), F.col("total")), 6).alias("pearson"))
    s = spearman(i, "pool", "share", "total").select("pool", "n", F.round("rho", 6).alias("spearman"))
    return s.join(p, "pool")


def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson's and Spearman's correlation of every measure with every impact over the rows that have all of them.

    ``density`` is the share per tick of the range, 0 for one without width; ``largest`` the greater of both directions.
    Each measure is ranked once, over distinct values; all correlations come from one row of ranks per position.
    """
    names = METRICS + TARGETS
    i = impacts(spark, sf_dir).withColumns({"density": F.when(F.col("range_width") > 0, F.col("share") / F.col("range_width")).otherwise(F.lit(0.0)), "largest": F.greatest("zero_for_one", "one_for_zero")})
    rows = cut(i.select("impact_id", *[F.col(c).cast("double").alias(c) for c in names]).dropna())
    long = rows.unpivot(["impact_id"], names, "measure", "value")
    ranks = average_ranks(long, "measure", "value").select("measure", "value", "rank")
    ranked = long.join(ranks, ["measure", "value"]).groupBy("impact_id").pivot("measure", names).agg(F.first("rank"))
    pairs = [(m, t) for m in METRICS for t in TARGETS]

    def table(df: DataFrame, name: str) -> DataFrame:
        one = df.agg(F.count("*").alias("n"), *[F.round(pearson(F.col(m), F.col(t)), 6).alias(f"{m}|{t}") for m, t in pairs])
        return one.unpivot(["n"], [f"{m}|{t}" for m, t in pairs], "pair", name)

    both = table(rows, "pearson").join(table(ranked, "spearman").drop("n"), "pair")
    return both.select(F.split("pair", "[|]")[0].alias("metric"), F.split("pair", "[|]")[1].alias("target"), "n", "pearson", "spearman")


def impact_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of total impact over all positions and by location (overlapping strata)."""
    rows = _located(spark, sf_dir).select(F.explode(F.array(F.lit("all"), "location")).alias("stratum"), "total")
    return interpolated_percentiles(rows, "stratum", "total", [0.25, 0.5, 0.75]).select("stratum", "n", *[F.round(f"q{i}", 9).alias(c) for i, c in enumerate(("q1", "median", "q3"))])


def impact_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each distinct total impact stands among those of its pool."""
    return percentile_of_value(impacts(spark, sf_dir).select("pool", "total"), "pool", "total").select("pool", "total", F.round("percentile", 9).alias("percentile"))


def pool_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = concentration(impacts(spark, sf_dir).select("pool", "total"), "pool", "total")
    return c.select("pool", "n", *[F.round(x, 6).alias(x) for x in ("hhi", "effective", "gini")])


def balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised differences of covariates between wide and narrow positions, with a verdict, by both rules for edges."""
    i = impacts(spark, sf_dir).where("range_width IS NOT NULL")
    names = ["share", "distance_to_nearest_edge", "total"]
    long = i.withColumn("wide", F.col("range_width") >= 10_000).select("wide", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["wide"], names, "covariate", "value")
    g = long.groupBy("covariate").agg(F.count("value").alias("n"), F.round(smd(F.col("value"), F.col("wide")), 6).alias("smd"), F.round(smd(F.col("value"), F.col("wide"), "nan_inf"), 6).alias("strict"))
    return g.withColumn("verdict", F.when(F.abs("smd") <= 0.1, "balanced").when(F.abs("smd") <= 0.2, "close").otherwise("unbalanced"))


def _skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impacts(spark, sf_dir).where("zero_for_one IS NOT NULL AND one_for_zero IS NOT NULL").select("pool", F.round(F.col("zero_for_one") - F.col("one_for_zero"), 9).alias("d"))


def signed_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed-rank statistic of the difference of directions by pool."""
    return wilcoxon(_skew(spark, sf_dir), "pool", "d").select("pool", "n", "w_plus", F.round("z", 8).alias("z"))


def adjusted_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p-values of the same test, adjusted over all pools and over each half of them."""
    t = wilcoxon(_skew(spark, sf_dir), "pool", "d").withColumn("family", F.explode(F.array(F.lit("all"), F.substring("pool", 3, 1))))
    return holm(t, ["family"], "p", ["pool"]).select("family", "pool", "n", F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"))


def adjusted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adjustment alone, over a score between 0 and 1 per pool."""
    t = impacts(spark, sf_dir).groupBy("pool").agg((F.count_if(F.col("total") == 0) / F.count("*") / 10).alias("p"))
    return holm(t.withColumn("family", F.substring("pool", 3, 1)), ["family"], "p", ["pool"]).select("family", "pool", F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"))


def mean_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference of directions with an interval by resampling and a test by random signs, by pool."""
    rows = cut(impacts(spark, sf_dir).where("zero_for_one IS NOT NULL AND one_for_zero IS NOT NULL").select("pool", "impact_id", (F.col("zero_for_one") - F.col("one_for_zero")).alias("d")))
    b = bootstrap_mean(rows, "pool", "d", DRAWS)
    return b.join(sign_flip(rows, "pool", "d", DRAWS).select("pool", "p"), "pool", "left")


QUERIES = {f.__name__: f for f in (share_correlation, correlation_matrix, impact_percentiles, impact_standing, pool_concentration, balance, signed_ranks, adjusted_tests, adjusted_scores, mean_intervals)}

_LOCATED = "located AS (SELECT *, CASE WHEN current_tick < tick_lower THEN 'below_current_tick' WHEN current_tick >= tick_upper THEN 'above_current_tick' WHEN current_tick IS NOT NULL AND tick_lower IS NOT NULL AND tick_upper IS NOT NULL THEN 'active' ELSE 'none' END AS location FROM impacts)"


def _r(x: str, y: str) -> str:
    return f"CASE WHEN count(*) >= 2 AND stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) ELSE 0 END"


_FULL = "full_ AS (SELECT * FROM (SELECT impact_id, share, range_width, distance_to_lower_tick, distance_to_upper_tick, distance_to_nearest_edge, CASE WHEN range_width > 0 THEN share / range_width ELSE 0 END AS density, zero_for_one, one_for_zero, total, greatest(zero_for_one, one_for_zero) AS largest FROM impacts) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in METRICS + TARGETS) + ")"
_RANKED = "ranked AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in METRICS + TARGETS) + " FROM full_)"
_PAIRS = " UNION ALL ".join(f"SELECT '{m}' AS metric, '{t}' AS target, (SELECT count(*) FROM full_) AS n, (SELECT round({_r(m, t)}, 6) FROM full_) AS pearson, (SELECT round({_r(m, t)}, 6) FROM ranked) AS spearman" for m in METRICS for t in TARGETS)
_WIDE = " UNION ALL ".join(f"SELECT '{c}' AS covariate, range_width >= 10000 AS wide, CAST({c} AS DOUBLE) AS v FROM impacts WHERE range_width IS NOT NULL" for c in ("share", "distance_to_nearest_edge", "total"))

ORACLE = {
    "share_correlation": sql(IMPACTS, """r AS (SELECT pool, share, total, rank() OVER (PARTITION BY pool ORDER BY share) + (count(*) OVER (PARTITION BY pool, share) - 1) / 2 AS a, rank() OVER (PARTITION BY pool ORDER BY total) + (count(*) OVER (PARTITION BY pool, total) - 1) / 2 AS b FROM impacts WHERE share IS NOT NULL AND total IS NOT NULL)""", f"SELECT pool, count(*) AS n, round({_r('share', 'total')}, 6) AS pearson, round({_r('a', 'b')}, 6) AS spearman FROM r GROUP BY 1"),
    "correlation_matrix": sql(IMPACTS, _FULL, _RANKED, _PAIRS),
    "impact_percentiles": sql(IMPACTS, _LOCATED, "s AS (SELECT 'all' AS stratum, total FROM located UNION ALL SELECT location, total FROM located)", "SELECT stratum, count(total) AS n, round(quantile_cont(total, 0.25), 9) AS q1, round(quantile_cont(total, 0.5), 9) AS median, round(quantile_cont(total, 0.75), 9) AS q3 FROM s GROUP BY 1"),
    "impact_standing": sql(IMPACTS, "SELECT DISTINCT pool, total, round(CASE WHEN count(*) OVER (PARTITION BY pool) <= 1 THEN 1 ELSE (count(*) OVER (PARTITION BY pool ORDER BY total RANGE UNBOUNDED PRECEDING) - 1) / (count(*) OVER (PARTITION BY pool) - 1) END, 9) AS percentile FROM impacts WHERE total IS NOT NULL"),
    "pool_concentration": sql(IMPACTS, "r AS (SELECT pool, total, row_number() OVER (PARTITION BY pool ORDER BY total) AS i FROM impacts WHERE total >= 0)", """SELECT pool, count(*) AS n, round(CASE WHEN sum(total) > 0 THEN sum(total * total) / (sum(total) * sum(total)) ELSE 0 END, 6) AS hhi, round(CASE WHEN sum(total) > 0 THEN (sum(total) * sum(total)) / sum(total * total) ELSE 0 END, 6) AS effective,
  round(CASE WHEN sum(total) > 0 THEN 2 * sum(total * i) / (count(*) * sum(total)) - (count(*) + 1) / count(*) ELSE 0 END, 6) AS gini FROM r GROUP BY 1"""),
    "balance": sql(IMPACTS, f"w AS ({_WIDE})", """g AS (SELECT covariate, count(v) AS n, (avg(v) FILTER (wide) - avg(v) FILTER (NOT wide)) / sqrt((coalesce(var_samp(v) FILTER (wide), 0) + coalesce(var_samp(v) FILTER (NOT wide), 0)) / 2) AS d FROM w GROUP BY 1)""", "SELECT covariate, n, round(d, 6) AS smd, round(d, 6) AS strict, CASE WHEN abs(d) <= 0.1 THEN 'balanced' WHEN abs(d) <= 0.2 THEN 'close' ELSE 'unbalanced' END AS verdict FROM g"),
    "signed_ranks": sql(IMPACTS, "d AS (SELECT pool, round(zero_for_one - one_for_zero, 9) AS d FROM impacts WHERE zero_for_one IS NOT NULL AND one_for_zero IS NOT NULL)", "r AS (SELECT pool, d, rank() OVER (PARTITION BY pool ORDER BY abs(d)) + (count(*) OVER (PARTITION BY pool, abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY pool, abs(d)) AS c FROM d WHERE d <> 0)", "g AS (SELECT pool, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, sum(c * c - 1) AS ties FROM r GROUP BY 1)", "v AS (SELECT *, w_plus - n * (n + 1) / 4 AS o, n * (n + 1) * (2 * n + 1) / 24 - ties / 48 AS s FROM g)", "SELECT pool, n, w_plus, round(CASE WHEN s > 0 THEN sign(o) * greatest(abs(o) - 0.5, 0) / sqrt(s) ELSE 0 END, 8) AS z FROM v"),
    "adjusted_scores": sql(IMPACTS, "t AS (SELECT pool, substr(pool, 3, 1) AS family, count(*) FILTER (total = 0) / count(*) / 10 AS p FROM impacts GROUP BY 1)", "s AS (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, pool) + 1) * p AS step FROM t)", "SELECT family, pool, round(p, 9) AS p, round(least(1, max(step) OVER (PARTITION BY family ORDER BY p, pool ROWS UNBOUNDED PRECEDING)), 9) AS p_holm FROM s"),
}
