"""Streaming ingestion of event files: confirmed windows, benign duplicates, running totals per pool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.functions.keys import clean_address
from riverbed.streaming.seen import STATE_CONF, configured


def pattern(path: str) -> str:
    """``path`` as a pattern, since a stream refuses the plain path of a single file."""
    return f"{path[:-1]}[{path[-1]}]"


def run_once(stream: DataFrame, checkpoint: str, sink, mode: str = "update") -> None:
    """Drain what is there now, each micro-batch into ``sink(batch, number)``, which must bear repetition."""
    with configured(stream.sparkSession, STATE_CONF):
        stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def single_events(stream: DataFrame, time: str, key: list[str], late: str = "1 hour") -> DataFrame:
    """Events once per key, where copies come within ``late`` of each other by event time."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def pool_totals(stream: DataFrame, time: str, window: str = "1 day", late: str | None = None) -> DataFrame:
    """Deliveries and sums of finite amounts per pool and window of event time, as they become known.

    The state is one row per pool and window whatever the number of rows, so it is kept and rows count however late they
    come.  With ``late`` as a watermark, windows are dropped once it has passed them, and later rows with them.
    """
    usd = F.when(~F.isnan("amount_usd") & (F.abs("amount_usd") < F.lit(float("inf"))), F.col("amount_usd"))
    rows = stream.select(clean_address("pool_address").alias("pool"), F.col(time).cast("timestamp").alias("t"), usd.alias("usd")).where("t IS NOT NULL")
    rows = rows.withWatermark("t", late) if late else rows
    return rows.groupBy(F.window("t", window).alias("w"), "pool").agg(F.count("*").alias("rows"), F.sum("usd").alias("usd")).select("pool", F.col("w.start").alias("start"), "rows", "usd")
