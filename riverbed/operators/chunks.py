"""Per-key results by exact offset chunking, for keys of which a few hold most rows.

Rows are laid out in key order over many range partitions.  Counting keys per partition and summing these counts in
partition order gives each partition the exact offset of each of its keys, hence each row its number within its key.
Numbers cut every key into chunks of equal size; chunks are processed independently and only their boundary states,
one small row per chunk, are merged in order.  No task ever sees more than one chunk of a key at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverbed.session import cut, shuffle_partitions

#: Rows of a key that one chunk holds.
CHUNK_ROWS = 100_000


def number_rows(df: DataFrame, key: str, order: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` with ``row_in_key``: 0, 1, 2, ... within each value of ``key`` in the order of ``order`` (nulls first).

    ``order`` should tell rows apart; rows that it does not tell apart get their numbers in any order.  A null key is
    a key like others.  The range partitions split a key wherever ``order`` allows, so that a hot key spans many.
    """
    partitions = partitions or 2 * shuffle_partitions(df.sparkSession)
    place = F.monotonically_increasing_id()
    laid = cut(
        df.repartitionByRange(partitions, key, *order)
        .sortWithinPartitions(key, *order)
        .withColumn("__part", F.shiftright(place, 33).cast("int"))
        .withColumn("__place", place.bitwiseAND(F.lit((1 << 33) - 1)))
    )
    counts = laid.groupBy("__part", F.col(key).alias("__key")).agg(F.count("*").alias("__rows"), F.min("__place").alias("__first"))
    before = F.sum("__rows").over(Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("__part").alias("__p"), "__key", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))
    numbered = laid.join(offsets, (F.col("__part") == F.col("__p")) & F.col(key).eqNullSafe(F.col("__key")))
    return numbered.withColumn("row_in_key", F.col("__place") + F.col("__shift")).drop("__part", "__p", "__key", "__place", "__shift")


def per_key_totals(df: DataFrame, key: str, item: str, order: list[str] | None = None, amount: str | None = None, chunk_rows: int = CHUNK_ROWS, also: list[str] | None = None) -> DataFrame:
    """``(key, row_count, item_count, amount_sum, also...)``: rows, distinct non-null ``item``, sums of ``amount`` and of ``also``.

    Items are counted as changes of ``item`` in the chunk's order, and a chunk that begins with the item that the
    chunk before ended with counts one less.  ``amount`` is a number or decimal column; nulls do not count, and a
    key without any amount has a null sum.  An empty table gives an empty result.
    """
    narrow = df.select(F.col(key).alias("k"), F.col(item).alias("i"), *([F.col(amount).alias("a")] if amount else [F.lit(None).cast("double").alias("a")]), *[F.col(c).alias(f"o{n}") for n, c in enumerate(order or [])], *[F.col(c).alias(f"x{n}") for n, c in enumerate(also or [])])
    extra = [f"x{n}" for n in range(len(also or []))]
    chunked = number_rows(narrow, "k", ["i", *[f"o{n}" for n in range(len(order or []))]]).withColumn("chunk", F.floor(F.col("row_in_key") / chunk_rows))
    within = Window.partitionBy("k", "chunk").orderBy("row_in_key")
    changed = chunked.select("k", "chunk", "i", "a", *extra, (F.col("i").isNotNull() & ~F.col("i").eqNullSafe(F.lag("i").over(within))).cast("long").alias("new"))
    states = changed.groupBy("k", "chunk").agg(F.count("*").alias("n"), F.sum("new").alias("items"), F.sum("a").alias("total"), F.min("i").alias("first"), F.max("i").alias("last"), *[F.sum(c).alias(c) for c in extra])
    seam = Window.partitionBy("k").orderBy("chunk")
    merged = states.select("k", "n", "total", *extra, (F.col("items") - F.coalesce((F.col("first") == F.lag("last").over(seam)).cast("long"), F.lit(0))).alias("items"))
    out = merged.groupBy("k").agg(F.sum("n").alias("row_count"), F.sum("items").alias("item_count"), F.sum("total").alias("amount_sum"), *[F.sum(x).alias(c) for x, c in zip(extra, also or [])])
    return out.withColumnRenamed("k", key)
