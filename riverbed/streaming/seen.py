"""Keyed state of the identifiers that an at-least-once feed has delivered.

A delivery has two identifiers: its id, and its place in the chain (block and position).  A structured stream keeps
each identifier it has seen with its first delivery in Spark's keyed state store, and tells of every further delivery
which earlier one it repeats: a link.  Identifiers are spread over a fixed number of hash buckets, one row of state
each, so that a task works on arrays instead of calling Python for every identifier.  Copies within a task are linked
before the shuffle, so an identifier of which there are very many is one row per task.

Event time is the block's, which copies of an action share up to ``SPREAD`` (a reorganised block).  An identifier leaves
the state once the watermark has passed it by more than ``SPREAD``, and goes to the archive, a table.  A copy that comes
later than that is behind the watermark: it is looked up in the archive, in its own micro-batch, by a join of the late
rows alone.  All that a micro-batch found is written under its number, so a batch that runs again after a failure
replaces what it wrote; state, archive and links advance together, and a later run goes on where this one ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riverbed.functions.keys import clean_key, key_hash

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.statefulOperator.checkCorrectness.enabled": "true",
}

#: Hash buckets of identifiers; fixed for the life of a checkpoint.  A bucket's state is 32 bytes per live identifier.
BUCKETS = 256
#: How far apart the event times of copies of one identifier may lie.
SPREAD = timedelta(hours=1)
#: Records that a task gathers before it links the copies among them.
BLOCK_RECORDS = 400_000

LINK, ARCHIVED, ASKED = 0, 1, 2
_ENTRY = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("first", "<i8"), ("at", "<i8")])
_FOUND = "what int, h1 long, h2 long, u long, v long"


@contextmanager
def configured(spark: SparkSession, conf: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def delivery_keys(df: DataFrame, *, id_col: str = "id", block_col: str = "block_number", log_col: str = "log_index", delivery_col: str = "delivery_id", also: list[str] | None = None) -> DataFrame:
    """``(id_key, block, log, delivery, also...)`` of each delivery.

    A null or blank identifier, and a position with a null part, link nothing: the key is null.  A delivery with
    neither gets a key of its own, so that it stays single.  Rows without a delivery number cannot be told apart from
    copies of one another and are left out.
    """
    placed = F.col(block_col).isNotNull() & F.col(log_col).isNotNull()
    name = F.coalesce(clean_key(id_col), F.when(~placed, F.concat(F.lit("\n"), F.col(delivery_col).cast("string"))))
    return df.where(F.col(delivery_col).isNotNull()).select(
        key_hash(name).alias("id_key"),
        F.when(placed, F.col(block_col)).cast("long").alias("block"),
        F.when(placed, F.col(log_col)).cast("int").alias("log"),
        F.col(delivery_col).cast("long").alias("delivery"),
        *(also or []),
    )


def _identifiers(df: DataFrame, id_col: str = "id", block_col: str = "block_number", log_col: str = "log_index", delivery_col: str = "delivery_id", time_col: str = "block_timestamp") -> DataFrame:
    """``(delivery, at, i1, i2, p1, p2)``: two hashes of the id and of the place, null where there is none; microseconds."""
    two = lambda kind, ok, *c: [F.when(ok, F.xxhash64(F.lit(n), F.lit(kind), *c)) for n in (1, 2)]
    name, placed = clean_key(id_col), F.col(block_col).isNotNull() & F.col(log_col).isNotNull()
    (i1, i2), (p1, p2) = two("id", name.isNotNull(), name), two("place", placed, F.col(block_col).cast("long"), F.col(log_col).cast("long"))
    at = F.coalesce(F.unix_micros(F.col(time_col).cast("timestamp")), F.lit(0))
    return df.where(F.col(delivery_col).isNotNull()).select(F.col(delivery_col).cast("long").alias("delivery"), at.alias("at"), i1.alias("i1"), i2.alias("i2"), p1.alias("p1"), p2.alias("p2"))


def _folded(e: np.ndarray, known: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries once per identifier: least delivery, latest time; whether it is among the first ``known``; links to it."""
    order = np.lexsort((e["first"], e["h2"], e["h1"]))
    e = e[order]
    new = np.r_[True, (e["h1"][1:] != e["h1"][:-1]) | (e["h2"][1:] != e["h2"][:-1])][: len(e)]
    start = np.flatnonzero(new)
    one = e[start]
    old = np.logical_or.reduceat(order < known, start) if len(e) else np.zeros(0, bool)
    if len(e):
        one["at"] = np.maximum.reduceat(e["at"], start)
    least = one["first"][np.cumsum(new) - 1]
    apart = e["first"] != least
    return one, old, e["first"][apart], least[apart]


def _spread(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[np.ndarray]) -> pa.RecordBatch:
            one, _, u, v = _folded(np.concatenate(held))
            # a link needs no identifier: it goes to any bucket and passes through
            h1, h2 = np.r_[one["h1"], u], np.r_[one["h2"], np.zeros(len(u), "<i8")]
            first, other = np.r_[one["first"], u], np.r_[np.full(len(one), -1), v]
            at = np.r_[one["at"], np.full(len(u), one["at"].max(initial=0))]
            return pa.RecordBatch.from_arrays([pa.array((h1 % buckets).astype("i4")), *map(pa.array, (h1, h2, first, other, at))], ["bucket", "h1", "h2", "first", "other", "at"])

        held, n = [], 0
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) if not c.null_count else c for c in b.columns]
            for c1, c2 in ((2, 3), (4, 5)):
                some = np.ones(len(b), bool) if not b.column(c1).null_count else b.column(c1).is_valid().to_numpy(zero_copy_only=False)
                e = np.empty(int(some.sum()), _ENTRY)
                for name, c in (("first", 0), ("at", 1), ("h1", c1), ("h2", c2)):
                    x = cols[c]
                    e[name] = x[some] if isinstance(x, np.ndarray) else x.drop_null().to_numpy(zero_copy_only=False)
                held.append(e)
                n += len(e)
            if n >= BLOCK_RECORDS:
                yield out(held)
                held, n = [], 0
        if n:
            yield out(held)

    return run


def _remember(spread_us: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames), ignore_index=True)
        known = np.frombuffer(state.get[0], _ENTRY) if state.exists else np.empty(0, _ENTRY)
        mark = state.getCurrentWatermarkMs() * 1000
        links = rows["other"].to_numpy() >= 0
        new = np.empty(int((~links).sum()), _ENTRY)
        for name in ("h1", "h2", "first", "at"):
            new[name] = rows[name].to_numpy()[~links]
        one, old, u, v = _folded(np.concatenate([known, new]), len(known))
        stay = one["at"] >= mark - spread_us
        # what leaves the state goes to the archive; late identifiers that the state did not know are to be looked up there
        gone, asked = one[~stay & old], one[~old & (one["at"] < mark)]
        state.update((one[stay].tobytes(),))
        parts = [(LINK, None, rows["first"].to_numpy()[links], rows["other"].to_numpy()[links]), (LINK, None, u, v), (ARCHIVED, gone, None, None), (ASKED, asked, None, None)]
        for what, e, a, b in parts:
            n = len(a) if e is None else len(e)
            if n:
                yield pd.DataFrame({"what": np.full(n, what, "i4"), "h1": e["h1"] if e is not None else 0, "h2": e["h2"] if e is not None else 0, "u": a if e is None else e["first"], "v": b if e is None else e["first"]})

    return step


def _registry(spark: SparkSession, registry: str) -> DataFrame:
    return spark.read.schema("h1 long, h2 long, u long, v long, batch long, what int").parquet(registry)


def stream_links(stream: DataFrame, registry: str, checkpoint: str, *, delay: str = "7 days", spread: timedelta = SPREAD, buckets: int = BUCKETS, **columns: str) -> None:
    """Run ``stream`` to its present end and add the links it finds to the tables at ``registry``.

    ``delay`` is that of the watermark on the event time: how long identifiers stay in the state.  A missing event time
    counts as the start of the epoch, so such rows are looked up in the archive once the watermark has moved.  Copies of
    an identifier must lie within ``spread`` of each other in event time.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], "h1 long, h2 long, u long, v long").write.mode("overwrite").parquet(f"{registry}/batch=-1/what={LINK}")

    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("what").parquet(f"{registry}/batch={number}")
        told = _registry(spark, registry)
        asked = told.where((F.col("batch") == number) & (F.col("what") == ASKED)).groupBy("h1", "h2").agg(F.min("u").alias("late"))
        if asked.limit(1).count():
            before = told.where((F.col("batch") < number) & F.col("what").isin(ARCHIVED, ASKED)).join(asked.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min("u").alias("v"))
            found = asked.join(before, ["h1", "h2"]).where("late <> v").select("h1", "h2", F.col("late").alias("u"), "v")
            found.write.mode("overwrite").parquet(f"{registry}/batch={number}/what={LINK + 10}")

    with configured(spark, STATE_CONF):
        rows = _identifiers(stream, **columns).mapInArrow(_spread(buckets), "bucket int, h1 long, h2 long, first long, other long, at long")
        timed = rows.withColumn("event", F.timestamp_micros("at")).withWatermark("event", delay)
        seen = timed.groupBy("bucket").applyInPandasWithState(_remember(spread // timedelta(microseconds=1)), _FOUND, "seen binary", "append", GroupStateTimeout.NoTimeout)
        seen.writeStream.outputMode("append").foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def links(spark: SparkSession, registry: str) -> DataFrame:
    """``(u, v)``: pairs of deliveries of one action, every repeated delivery with an earlier or later one of it."""
    return _registry(spark, registry).where(F.col("what").isin(LINK, LINK + 10)).select("u", "v")
