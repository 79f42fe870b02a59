"""Named queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.functions.keys import clean_address, clean_key
from riverbed.llm.nearest import nearest_times
from riverbed.llm.packing import fill, pack, segments
from riverbed.llm.percentiles import exact_percentiles, interval_counts, merge_counts, percentiles_of_counts, value_counts
from riverbed.llm.reading import reading_levels
from riverbed.llm.tokens import token_counts, token_ids
from riverbed.llm.topn import parts_of, top_n
from riverbed.plans.base import BLANK, address_sql
from riverbed.session import cut, read

#: Blocks within which a snapshot belongs to an action.
TOLERANCE = 300
PERMILLE = [500, 900, 990]
#: Tokens of a container.
CAPACITY = 2048
#: Years of schooling from which a page is reported.
SCHOOLING = 13


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest snapshot of its pool for each delivery that has one within 300 blocks."""
    actions = read(spark, sf_dir, "lp_actions").select("delivery_id", clean_address("pool_address").alias("pool"), "block_number")
    snapshots = read(spark, sf_dir, "pool_snapshots").select(clean_address("pool_address").alias("pool"), "block_number")
    return nearest_times(actions, snapshots, TOLERANCE, key="pool", time="block_number", out="snapshot_block").where("snapshot_block IS NOT NULL").select("delivery_id", "snapshot_block")


def _measured(found: DataFrame, value: str) -> DataFrame:
    """Percentiles as doubles and, of decimals, as they are."""
    exact = [(F.col(f"p{p}") if value != "amount_usd" else F.lit(None)).cast("decimal(38,18)").alias(f"exact_p{p}") for p in PERMILLE]
    return found.select("pool_address", F.lit(value).alias("measure"), "row_count", *[F.col(f"p{p}").cast("double").alias(f"p{p}") for p in PERMILLE], *exact)


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact median, 90th and 99th percentile per pool of the amounts of actions and of the impacts of positions."""
    out = []
    for table, value in (("lp_actions", "amount_usd"), ("position_impacts", "total_lsis_bps")):
        rows = read(spark, sf_dir, table).select(clean_address("pool_address").alias("pool_address"), value)
        out.append(_measured(exact_percentiles(rows, ["pool_address"], value, PERMILLE), value))
    return out[0].unionByName(out[1])


def p3_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same percentiles of amounts, exactly, from states that were made day by day."""
    rows = read(spark, sf_dir, "lp_actions").select(clean_address("pool_address").alias("pool_address"), F.col("ingested_at").cast("date").alias("day"), "amount_usd")
    days = cut(value_counts(rows, ["pool_address", "day"], "amount_usd"))
    return _measured(exact_percentiles(days, ["pool_address"], "amount_usd", PERMILLE, weight="rows"), "amount_usd")


def p3_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the same percentiles of amounts, from one state of bounded size per day of arrival, combined."""
    rows = read(spark, sf_dir, "lp_actions").select(clean_address("pool_address").alias("pool_address"), F.col("ingested_at").cast("date").alias("day"), "amount_usd")
    days = cut(interval_counts(rows, ["pool_address", "day"], "amount_usd"))
    return percentiles_of_counts(merge_counts(days, ["pool_address"]), ["pool_address"], PERMILLE)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3 rows of highest total impact of every position key.

    Rows of the same pool, snapshot and key count once, as the one with the smallest impact_id; where pool or
    snapshot is null, a row is a copy of no other.  Rows without a key, an impact_id or a score are no cases; a
    missing block sorts last.
    """
    rows = read(spark, sf_dir, "position_impacts").where("impact_id IS NOT NULL").select(
        clean_key("position_key").alias("key"),
        clean_address("pool_address").alias("pool"),
        "snapshot_index",
        F.when(F.col("pool_address").isNull() | F.col("snapshot_index").isNull(), F.col("impact_id")).alias("alone"),
        F.struct("impact_id", *parts_of(F.col("total_lsis_bps"), descending=True), "block_number").alias("row"),
    )
    single = cut(
        rows.where("key IS NOT NULL").groupBy("key", "pool", "snapshot_index", "alone").agg(F.min("row").alias("row")).where("row.part0 IS NOT NULL")
        .select("key", "row.part0", "row.part1", "row.part2", F.coalesce("row.block_number", F.lit((1 << 63) - 1)).alias("block"), F.col("row.impact_id").alias("impact_id"))
    )
    return top_n(single, "key", ["part0", "part1", "part2", "block", "impact_id"], 3).select("impact_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document by byte_bpe_50k."""
    return token_ids(read(spark, sf_dir, "documents"), "text", ["doc_id"])


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = token_counts(read(spark, sf_dir, "documents"), "text", ["doc_id", "source"])
    return pack(sizes, "doc_id", "source", "tokens", CAPACITY)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the packing divides, as they alone exceed a container."""
    return _packed(spark, sf_dir).where("segments > 1").select(F.col("item").alias("doc_id"))


def p7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of all containers."""
    return segments(_packed(spark, sf_dir), CAPACITY).withColumnRenamed("item", "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containers of each window and the room left over in them."""
    return fill(_packed(spark, sf_dir), CAPACITY)


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each source in each window."""
    return _packed(spark, sf_dir).where("segments > 0").groupBy("window", "source").agg(F.sum("tokens").alias("tokens"))


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading level of every document."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "line_boxes")
    return reading_levels(documents, read(spark, sf_dir, "reading_labels"), boxes="line_boxes", cut=cut)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of running English whose level is 13 or more years."""
    return p8_levels(spark, sf_dir).where(F.col("running") & (F.col("level") >= SCHOOLING)).select("doc_id")


def _ranked(table: str, value: str) -> str:
    where = f"isfinite({value})" if value == "amount_usd" else f"{value} IS NOT NULL"
    pick = "max(CASE WHEN rn = greatest(1, (n * {0} + 999) // 1000) THEN v END)"
    exact = pick if value != "amount_usd" else "NULL"
    picks = ", ".join(f"CAST({pick.format(p)} AS DOUBLE) AS p{p}, CAST({exact.format(p)} AS DECIMAL(38,18)) AS exact_p{p}" for p in PERMILLE)
    return f"""SELECT g AS pool_address, '{value}' AS measure, n AS row_count, {picks} FROM (
  SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) AS rn, count(*) OVER (PARTITION BY g) AS n
  FROM (SELECT {address_sql('pool_address')} AS g, {value}{' + 0.0::DOUBLE' if value == 'amount_usd' else ''} AS v FROM {table} WHERE {where})) GROUP BY g, n"""


QUERIES = {"p2_found": p2_found, "p3_percentiles": p3_percentiles, "p3_combined": p3_combined, "p3_daily": p3_daily, "p5_found": p5_found, "p6_ids": p6_ids, "p7_found": p7_found, "p7_segments": p7_segments, "p7_fill": p7_fill, "p7_mixture": p7_mixture, "p8_found": p8_found, "p8_levels": p8_levels}

ORACLE = {
    "p2_found": f"""
WITH a AS (SELECT delivery_id, {address_sql('pool_address')} AS pool, block_number AS b FROM lp_actions),
s AS (SELECT DISTINCT {address_sql('pool_address')} AS pool, block_number AS b FROM pool_snapshots),
c AS (SELECT a.delivery_id, s.b, row_number() OVER (PARTITION BY a.delivery_id ORDER BY abs(s.b - a.b), s.b) AS rn
  FROM a JOIN s ON s.pool = a.pool AND s.b BETWEEN a.b - {TOLERANCE} AND a.b + {TOLERANCE})
SELECT delivery_id, b AS snapshot_block FROM c WHERE rn = 1""",
    "p3_percentiles": _ranked("lp_actions", "amount_usd") + " UNION ALL " + _ranked("position_impacts", "total_lsis_bps"),
    "p3_combined": _ranked("lp_actions", "amount_usd"),
    "p5_found": f"""
WITH d AS (SELECT *, lower(trim(position_key, {BLANK})) AS k, row_number() OVER (
    PARTITION BY lower(trim(position_key, {BLANK})), {address_sql('pool_address')}, snapshot_index ORDER BY impact_id) AS copy FROM position_impacts),
r AS (SELECT impact_id, row_number() OVER (PARTITION BY k ORDER BY total_lsis_bps DESC, block_number, impact_id) AS rn
  FROM d WHERE copy = 1 AND total_lsis_bps IS NOT NULL)
SELECT impact_id FROM r WHERE rn <= 3""",
}
