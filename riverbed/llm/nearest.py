"""Matching of records by nearest time, with x-fast tries over the bits of the time.

Time is cut into cells at least as wide as the tolerance, so a match lies in the record's own cell or in one beside
it.  Each cell of an entity is one x-fast trie: a hash table per prefix length that leads from a prefix to the least
and greatest leaf below it.  A binary search over prefix lengths finds the longest prefix of the wanted time that the
trie holds; the leaf that bounds that node is predecessor or successor, its neighbour in the sorted leaves the other.

Only distinct (entity, time) pairs enter the tries, so a cell holds no more entries than it has time steps, however
many records share an entity, a cell or a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.session import shuffle_partitions


class XFastTries:
    """Tries over sorted distinct keys; the low ``bits`` of a key are the time, those above name the trie."""

    def __init__(self, leaves: np.ndarray, bits: int):
        self.leaves, self.bits, self.levels = leaves, bits, []
        for shift in range(bits + 1):
            prefixes = leaves >> shift
            first = np.flatnonzero(np.r_[True, prefixes[1:] != prefixes[:-1]]) if len(leaves) else np.zeros(0, np.int64)
            last = np.r_[first[1:], len(leaves)] - 1 if len(first) else first
            self.levels.append((pd.Index(prefixes[first]), first, last))

    def around(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of predecessor and successor of each key in the leaves, -1 where its trie has none."""
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), self.bits + 1)
        node = np.full(len(wanted), -1)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            for shift in np.unique(middle[open_]):
                rows = np.flatnonzero(open_ & (middle == shift))
                at = self.levels[shift][0].get_indexer(wanted[rows] >> shift)
                hit = at >= 0
                node[rows[hit]], high[rows[hit]] = at[hit], shift
                low[rows[~hit]] = shift + 1
        before, after = np.full(len(wanted), -1), np.full(len(wanted), -1)
        for shift in np.unique(low[low <= self.bits]):
            rows = np.flatnonzero(low == shift)
            _, first, last = self.levels[shift]
            if shift == 0:
                before[rows] = after[rows] = first[node[rows]]
                continue
            right = (wanted[rows] >> (shift - 1)) & 1 == 1
            before[rows] = np.where(right, last[node[rows]], first[node[rows]] - 1)
            after[rows] = before[rows] + 1
        for found, inside in ((before, before >= 0), (after, (after >= 0) & (after < len(self.leaves)))):
            same = np.zeros(len(wanted), bool)
            same[inside] = self.leaves[found[inside]] >> self.bits == wanted[inside] >> self.bits
            found[~same] = -1
        return before, after


def _match(bits: int, tolerance: int):
    wide = bits + 2

    def match(wanted: pa.Table, known: pa.Table) -> pa.Table:
        k = pa.chunked_array([*wanted["k"].chunks, *known["k"].chunks], wanted.schema.field("k").type).combine_chunks().dictionary_encode()
        t = np.r_[wanted["t"].to_numpy(), known["t"].to_numpy()].astype(np.int64)
        cell = np.r_[wanted["cell"].to_numpy(), known["cell"].to_numpy()].astype(np.int64)
        names = k.indices.to_numpy(zero_copy_only=False) if isinstance(k, pa.DictionaryArray) else k.combine_chunks().indices.to_numpy(zero_copy_only=False)
        tries, _ = pd.factorize(pd.MultiIndex.from_arrays([names, cell]))
        keys = (tries.astype(np.int64) << wide) | (t - ((cell - 1) << bits))
        leaves, ask, t = np.unique(keys[len(wanted) :]), keys[: len(wanted)], t[: len(wanted)]
        if not len(leaves) or not len(ask):
            return pa.table({"k": wanted["k"].slice(0, 0), "t": pa.array([], pa.int64()), "m": pa.array([], pa.int64())})
        before, after = XFastTries(leaves, wide).around(ask)
        never = np.iinfo(np.int64).max
        back = np.where(before >= 0, ask - leaves[before], never)
        ahead = np.where(after >= 0, leaves[after] - ask, never)
        earlier = back <= ahead
        gap = np.where(earlier, back, ahead)
        found = gap <= tolerance
        return pa.table({"k": wanted["k"].filter(pa.array(found)), "t": pa.array(t[found]), "m": pa.array(np.where(earlier, t - gap, t + gap)[found])})

    return match


def nearest_times(left: DataFrame, right: DataFrame, tolerance: int, *, key: str, time: str, right_key: str | None = None, right_time: str | None = None, out: str = "nearest") -> DataFrame:
    """``left`` with the column ``out``: the time of the nearest record of ``right`` with the same key.

    Nearest means at most ``tolerance`` away, before or after; of two equally near the earlier; an equal time counts
    as distance 0.  ``out`` is null where there is none, and where key or time is null.  Every row of ``left`` comes
    out once for each time it is there.  Times are whole numbers within +-2^60.  A column of ``left`` that is called
    ``out`` is replaced.
    """
    spark = left.sparkSession
    bits = max(1, int(tolerance).bit_length())
    width = 1 << bits
    parts = 8 * shuffle_partitions(spark)
    k, t, cell = F.col("k"), F.col("t"), F.col("cell")
    part = F.pmod(F.xxhash64("k", "cell"), F.lit(parts)).cast("int").alias("part")
    wanted = left.select(F.col(key).alias("k"), F.col(time).cast("long").alias("t")).where("k IS NOT NULL AND t IS NOT NULL").distinct().withColumn("cell", F.shiftright("t", bits)).select(part, k, cell, t)
    home = F.shiftright("t", bits)
    reach = F.array_compact(F.array(home, F.when(t - tolerance < home * width, home - 1), F.when(t + tolerance >= (home + 1) * width, home + 1)))
    known = (
        right.select(F.col(right_key or key).alias("k"), F.col(right_time or time).cast("long").alias("t"))
        .where("k IS NOT NULL AND t IS NOT NULL")
        .distinct()
        .select(k, F.explode(reach).alias("cell"), t)
        .select(part, k, cell, t)
    )
    kind = left.schema[key].dataType.simpleString()
    found = wanted.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(_match(bits, int(tolerance)), f"k {kind}, t long, m long")
    rows = left.drop(out).alias("l")
    return rows.join(found.alias("f"), (F.col(f"l.{key}") == F.col("f.k")) & (F.col(f"l.{time}").cast("long") == F.col("f.t")), "left").select("l.*", F.col("f.m").alias(out))
