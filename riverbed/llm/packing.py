"""Filling of fixed-capacity containers with items of several sources in controlled proportions.

Sources are queues served by deficit round-robin: in every window a source's counter grows by its quantum, its share of
the window's tokens, and it sends items from the head of its queue while the counter covers them; what is left of the
counter is carried to the next window.  The item that ends at token T of its queue is therefore covered first in window

    max(0, ceil((T - start) / quantum) - 1)

where ``start`` is what the counter holds before the first window.  So a running total per source, with exact offsets of
its partitions, replaces the round-robin loop: counters carry across windows and partitions without any task seeing a
whole queue.  ``start`` is a part of the source's largest item that its name's hash says: sources whose quantum is less
than an item would otherwise all send their first item in the same window.  Each window is then packed on its own by
best fit decreasing.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.operators.ordered import running_totals
from riverbed.session import cut

#: Containers of one window.
WINDOW = 1024


def _windows(items: DataFrame, capacity: int, window: int, targets: dict[str, float] | None) -> DataFrame:
    """Items with the window that deficit round-robin serves them in; queues are in the order of a hash of the item."""
    sources = items.groupBy("source").agg(F.sum("tokens").cast("double").alias("queued"), F.max("tokens").alias("largest"))
    whole = sources.agg(F.sum("queued").alias("whole"))
    sources = sources.crossJoin(F.broadcast(whole))
    share = F.col("queued") / F.col("whole")
    if targets:
        named = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(float(v))) for s, v in targets.items()], F.lit(0.0))
        rest = sources.agg(F.sum(F.when(named == 0, F.col("queued")).otherwise(0.0)).alias("rest"))
        sources = sources.crossJoin(F.broadcast(rest))
        share = F.when(named > 0, named).otherwise(F.lit(max(1 - sum(targets.values()), 1e-6)) * F.col("queued") / F.col("rest"))
    part = F.pmod(F.xxhash64(F.coalesce("source", F.lit("\0"))), F.lit(1 << 20)) / F.lit(float(1 << 20))
    quanta = sources.select(F.col("source").alias("__s"), F.greatest(F.lit(1), F.round(share * (window * capacity))).cast("long").alias("quantum"), F.floor(part * F.col("largest")).alias("start"))
    queued = running_totals(items.withColumn("turn", F.xxhash64("item")), ["source"], ["turn", "item"], ["tokens"])
    turn = F.greatest(F.lit(0), F.floor((F.col("tokens_upto") - F.col("start") - 1) / F.col("quantum"))).cast("long")
    return queued.join(quanta, F.col("source").eqNullSafe(F.col("__s"))).withColumn("window", turn).drop("__s", "turn", "tokens_upto", "start", "quantum")


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A container for each size, 0, 1, ...: largest first, each where it leaves least room."""
    at, room, used = np.empty(len(sizes), np.int64), [], 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        k = bisect_left(room, (size, -1))
        free, slot = room.pop(k) if k < len(room) else (capacity, used)
        used += slot == used
        at[i] = slot
        if free > size:
            insort(room, (free - size, slot))
    return at


def _pack(capacity: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item", ignore_index=True)
        tokens = rows["tokens"].to_numpy()
        full, rest = tokens // capacity, tokens % capacity
        slot = np.full(len(rows), -1)
        some = rest > 0
        slot[some] = best_fit(rest[some], capacity)
        first = slot.max(initial=-1) + 1 + np.cumsum(full) - full
        rows["full"], rows["full_slot"], rows["rest"], rows["rest_slot"] = full, np.where(full > 0, first, -1), rest, slot
        return rows[["window", "item", "source", "tokens", "full", "full_slot", "rest", "rest_slot"]]

    return pack


def pack(df: DataFrame, item: str, source: str, tokens: str, capacity: int = 2048, window: int = WINDOW, targets: dict[str, float] | None = None) -> DataFrame:
    """Where each item goes: ``(item, source, tokens, window, segments, full, full_slot, rest, rest_slot)``.

    A container is a window and a slot of it.  An item no larger than ``capacity`` lies whole in ``rest_slot``; a
    larger one fills ``full`` containers from ``full_slot`` on and its ``rest`` tokens share ``rest_slot``.  A slot of
    -1 means that there is no such part.  Items of no or unknown size need no container: their window is null and
    they have no segments.  Windows hold the sources in the proportions of ``targets`` (shares of tokens by source;
    those not named share what is left by their tokens), or of the whole corpus where that is None, up to one item per
    source.  Items should be distinct numbers; a null source is a source of its own.
    """
    items = df.select(F.col(item).alias("item"), F.col(source).alias("source"), F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("tokens"))
    items = cut(items)
    kind = df.schema[item].dataType.simpleString()
    placed = _windows(items.where("tokens > 0"), capacity, window, targets).groupBy("window").applyInPandas(
        _pack(capacity), f"window long, item {kind}, source string, tokens long, full long, full_slot long, rest long, rest_slot long"
    )
    none = items.where("tokens <= 0").select(F.lit(None).cast("long").alias("window"), "item", "source", "tokens", *[F.lit(v).cast("long").alias(c) for c, v in (("full", 0), ("full_slot", -1), ("rest", 0), ("rest_slot", -1))])
    return placed.unionByName(none).withColumn("segments", F.col("full") + (F.col("rest") > 0).cast("long"))


def segments(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row per part of an item: ``(window, slot, item, segment, first_token, tokens)``."""
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("segments") - 1)).alias("segment")
    rows = packed.where("segments > 0").select("*", part)
    whole = F.col("segment") < F.col("full")
    return rows.select(
        "window", F.when(whole, F.col("full_slot") + F.col("segment")).otherwise(F.col("rest_slot")).alias("slot"), "item", "segment",
        (F.col("segment") * capacity).alias("first_token"), F.when(whole, F.lit(capacity).cast("long")).otherwise(F.col("rest")).alias("tokens"),
    )


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """``(window, containers, tokens, room)``: containers used by each window and the share of their room left over."""
    used = segments(packed, capacity).groupBy("window", "slot").agg(F.sum("tokens").alias("t"))
    return used.groupBy("window").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens")).withColumn("room", 1 - F.col("tokens") / (F.col("containers") * capacity))
