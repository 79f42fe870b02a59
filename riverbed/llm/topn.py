"""The highest N items of every group, by lower bounds from partitions.

The N-th best row that one block of a partition holds of a group bounds the group's N-th best from below.  The best
such bound of each group removes nearly all rows of large groups before anything is ranked; what is left of a group
is at most N rows per block, and small groups pass whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a partition among which local bounds are looked for at once.
BLOCK_ROWS = 500_000


def parts_of(value: Column, descending: bool = False) -> list[Column]:
    """A decimal(38,18) as three longs ``part0``, ``part1``, ``part2`` that order as it does, any of its 38 digits."""
    billion = F.lit(10**10).cast("decimal(11,0)")
    whole, rest = F.floor(value), F.try_mod(value, F.lit(1).cast("decimal(1,0)")).cast("decimal(19,18)")
    high = F.floor(whole / billion)
    # the product is a whole number, so the digits after the point that its type has no room for are zeros
    below = (F.when(rest < 0, rest + F.lit(1).cast("decimal(1,0)")).otherwise(rest) * F.lit(10**18)).cast("long")
    parts = [high.cast("long"), (whole - high * billion).cast("long"), below]
    return [(-p if descending else p).alias(f"part{i}") for i, p in enumerate(parts)]


def _bounds(n: int, order: list[str]):
    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= BLOCK_ROWS:
                yield pd.concat(held, ignore_index=True)
                held, rows = [], 0
        if rows:
            yield pd.concat(held, ignore_index=True)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks(batches):
            codes, _ = pd.factorize(block["k"])
            at = np.lexsort([block[c].to_numpy() for c in reversed(order)] + [codes])
            codes = codes[at]
            start = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            size = np.diff(np.r_[start, len(codes)])
            if (size >= n).any():
                yield block.iloc[at[start[size >= n] + n - 1]]

    return local


def top_n(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each ``key`` in the ascending order of the long columns ``order``, with ``place`` 1 to n.

    ``order`` must tell the rows of a key apart; then the result is the same on every run.  A group of fewer rows
    comes out whole.  Rows with a null key or a null in ``order`` belong to no group and are left out.  ``df`` is
    read twice, so it should be a table or a checkpoint.
    """
    rows = df.where(F.col(key).isNotNull()).dropna(subset=order)
    kind = df.schema[key].dataType.simpleString()
    local = rows.select(F.col(key).alias("k"), *[F.col(c).cast("long").alias(f"o{i}") for i, c in enumerate(order)])
    names = [f"o{i}" for i in range(len(order))]
    bounds = local.mapInPandas(_bounds(n, names), f"k {kind}, " + ", ".join(f"{c} long" for c in names))
    best = bounds.groupBy(F.col("k").alias("__key")).agg(F.min(F.struct(*names)).alias("__bound"))
    here = F.struct(*[F.col(c).cast("long").alias(f"o{i}") for i, c in enumerate(order)])
    left = rows.join(best, F.col(key) == F.col("__key"), "left").where(F.col("__bound").isNull() | (here <= F.col("__bound"))).drop("__key", "__bound")
    return left.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)
