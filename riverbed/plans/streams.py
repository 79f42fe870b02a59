"""Queries that run as streams over the files of a table, drained once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.functions.keys import clean_address
from riverbed.plans.base import address_sql
from riverbed.session import fresh_path, read
from riverbed.streaming.ingest import pattern, pool_totals, run_once


def streamed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of each pool by day of their block, kept in state and written as they change."""
    path, out = f"{sf_dir}/lp_actions.parquet", fresh_path(spark, "days")
    stream = spark.readStream.schema(read(spark, sf_dir, "lp_actions").schema).parquet(pattern(path))
    run_once(pool_totals(stream, "block_timestamp"), fresh_path(spark, "days-state"), lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    told = spark.read.parquet(out)
    return told.groupBy("pool", F.to_date("start").alias("day")).agg(F.max_by("rows", "batch").alias("rows")).select("pool", F.date_format("day", "yyyy-MM-dd").alias("day"), "rows")


def swap_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swaps by sliding windows of two hours every hour, as a batch."""
    s = read(spark, sf_dir, "swaps").select(clean_address("pool_address").alias("pool"), F.timestamp_seconds("timestamp_unix").alias("t"))
    g = s.groupBy(F.window("t", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("swaps"), F.countDistinct("pool").alias("pools"))
    return g.select(F.unix_timestamp("w.start").alias("start"), "swaps", "pools")


QUERIES = {f.__name__: f for f in (streamed_days, swap_buckets)}

ORACLE = {
    "streamed_days": f"SELECT {address_sql('pool_address')} AS pool, strftime(block_timestamp, '%Y-%m-%d') AS day, count(*) AS rows FROM lp_actions WHERE block_timestamp IS NOT NULL GROUP BY 1, 2",
    "swap_buckets": f"SELECT (timestamp_unix // 3600 - k) * 3600 AS start, count(*) AS swaps, count(DISTINCT {address_sql('pool_address')}) AS pools FROM swaps, range(2) t(k) GROUP BY 1",
}
