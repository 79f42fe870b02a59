"""Statistics over skewed keys: ranks, percentiles, correlations, concentration, balance, tests, resampling.

Whatever needs a key's values in order works on distinct values with their counts, so that neither a key nor one value
that very many rows share is gathered in one task; ranks are running totals of the counts.  Whatever resamples adds up
partial sums per partition.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverbed.operators.chunks import number_rows
from riverbed.operators.ordered import running_totals
from riverbed.session import cut, shuffle_partitions


def _counted(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, value, copies, upper)`` per distinct value that is not null: its count and that of values up to it."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("copies"))
    return running_totals(counts, [key], [value], ["copies"]).withColumnRenamed("copies_upto", "upper")


def average_ranks(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, value, rank, upper, copies)`` per distinct value: its 1-based average rank, highest rank and count."""
    return _counted(df, key, value).select(key, value, (F.col("upper") - (F.col("copies") - 1) / 2).alias("rank"), "upper", "copies")


def percentile_of_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, value, percentile)`` per distinct value: (highest rank - 1) / (n - 1), 1 where a key has one row."""
    ranks = average_ranks(df, key, value)
    n = ranks.groupBy(F.col(key).alias("__k")).agg(F.sum("copies").alias("n"))
    return ranks.join(n, F.col(key).eqNullSafe(F.col("__k"))).select(key, value, F.when(F.col("n") <= 1, F.lit(1.0)).otherwise((F.col("upper") - 1) / (F.col("n") - 1)).alias("percentile"))


def interpolated_percentiles(df: DataFrame, key: str, value: str, parts: list[float]) -> DataFrame:
    """``(key, n, q0, q1, ...)``: percentiles by linear interpolation between ranks, exact; nulls do not count."""
    counted = _counted(df.select(key, F.col(value).cast("double").alias("v")), key, "v")
    n = counted.groupBy(F.col(key).alias("__k")).agg(F.sum("copies").alias("n"))
    rows = counted.join(n, F.col(key).eqNullSafe(F.col("__k")))
    places = [(F.col("n") - 1) * p for p in parts]
    holds = lambda at: (at < F.col("upper")) & (at >= F.col("upper") - F.col("copies"))
    wanted = reduce(lambda a, b: a | b, [holds(F.floor(p)) | holds(F.ceil(p)) for p in places])

    def pick(p: Column) -> Column:
        low = F.max(F.when(holds(F.floor(p)), F.col("v")))
        high = F.max(F.when(holds(F.ceil(p)), F.col("v")))
        return low + (high - low) * F.max(p - F.floor(p))

    return rows.where(wanted).groupBy(key, "n").agg(*[pick(p).alias(f"q{i}") for i, p in enumerate(places)])


def pearson(x: Column, y: Column, empty: float | None = 0.0) -> Column:
    """Correlation over rows that have both values; ``empty`` for fewer than two rows or no variance."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    n, sx, sy = F.count(x), F.stddev_pop(x), F.stddev_pop(y)
    return F.when((n >= 2) & (sx > 0) & (sy > 0), F.try_divide(F.covar_pop(x, y), sx * sy)).otherwise(F.lit(empty).cast("double"))


def spearman(df: DataFrame, key: str, x: str, y: str, empty: float | None = 0.0) -> DataFrame:
    """``(key, n, rho)``: Pearson's correlation of average ranks over rows that have both values."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"))
    rx = average_ranks(rows, "k", "x").select(F.col("k").alias("k1"), F.col("x").alias("x1"), F.col("rank").alias("rx"))
    ry = average_ranks(rows, "k", "y").select(F.col("k").alias("k2"), F.col("y").alias("y2"), F.col("rank").alias("ry"))
    both = rows.join(rx, F.col("k").eqNullSafe(F.col("k1")) & (F.col("x") == F.col("x1"))).join(ry, F.col("k").eqNullSafe(F.col("k2")) & (F.col("y") == F.col("y2")))
    return both.groupBy(F.col("k").alias(key)).agg(F.count("*").alias("n"), pearson(F.col("rx"), F.col("ry"), empty).alias("rho"))


def concentration(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, n, total, hhi, effective, gini)`` of the values that are not negative; 0 where their sum is 0."""
    rows = _counted(df.where(F.col(value) >= 0).select(key, F.col(value).cast("double").alias("v")), key, "v")
    v, m = F.col("v"), F.col("copies")
    a = rows.groupBy(key).agg(F.sum("copies").alias("n"), F.sum(v * m).alias("total"), F.sum(v * v * m).alias("squares"), F.sum(v * m * (F.col("upper") - (m - 1) / 2)).alias("weighted"))
    some = F.col("total") > 0
    hhi = F.when(some, F.col("squares") / (F.col("total") * F.col("total"))).otherwise(F.lit(0.0))
    gini = F.when(some, 2 * F.col("weighted") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n")).otherwise(F.lit(0.0))
    return a.select(key, "n", "total", hhi.alias("hhi"), F.when(some, 1 / hhi).otherwise(F.lit(0.0)).alias("effective"), gini.alias("gini"))


def smd(value: Column, treated: Column, edge: str = "zero") -> Column:
    """Standardised mean difference of two samples.

    ``edge`` is ``zero``: 0 where a side is empty or nothing varies; or ``nan_inf``: NaN with fewer than two values on
    a side, and infinity for unlike means without variance.
    """
    a, b = F.when(treated, value.cast("double")), F.when(~treated, value.cast("double"))
    pooled = F.sqrt((F.coalesce(F.var_samp(a), F.lit(0.0)) + F.coalesce(F.var_samp(b), F.lit(0.0))) / 2)
    gap = F.avg(a) - F.avg(b)
    if edge == "zero":
        return F.coalesce(F.when(pooled > 0, gap / pooled), F.lit(0.0))
    few = (F.count(a) < 2) | (F.count(b) < 2)
    return F.when(few, F.lit(float("nan"))).when(pooled > 0, gap / pooled).when(gap == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))


def holm(df: DataFrame, family: list[str], p: str, order: list[str]) -> DataFrame:
    """``df`` with ``p_holm``: step-down adjusted p-values within each family of tests."""
    rows = df.withColumn("__family", F.struct(*family))
    n = rows.groupBy(F.col("__family").alias("__f")).agg(F.count("*").alias("__n"))
    placed = number_rows(rows, "__family", [p, *order]).join(n, F.col("__family") == F.col("__f"))
    steps = placed.withColumn("__step", (F.col("__n") - F.col("row_in_key")) * F.col(p))
    most = running_totals(steps, ["__family"], ["row_in_key"], ["__step"], how=F.max)
    return most.select(*df.columns, F.least(F.lit(1.0), "__step_upto").alias("p_holm"))


@F.pandas_udf(T.DoubleType())
def two_sided(z: pd.Series) -> pd.Series:
    """Two-sided p-value of a standard normal statistic."""
    return z.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2)))


def wilcoxon(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, n, w_plus, z, p)``: signed-rank test of the median 0, normal approximation with ties and continuity.

    Zeros and nulls are dropped; a key without other values has z 0 and p 1.
    """
    rows = df.where(F.col(value).isNotNull() & (F.col(value) != 0)).select(key, F.abs(value).alias("size"), (F.col(value) > 0).alias("up"))
    ranks = average_ranks(rows, key, "size").select(F.col(key).alias("__k"), F.col("size").alias("__s"), "rank", "copies")
    placed = rows.groupBy(key, "size").agg(F.count_if("up").alias("ups")).join(ranks, F.col(key).eqNullSafe(F.col("__k")) & (F.col("size") == F.col("__s")))
    a = placed.groupBy(key).agg(F.sum("copies").alias("n"), F.sum(F.col("ups") * F.col("rank")).alias("w_plus"), F.sum(F.pow("copies", F.lit(3.0)) - F.col("copies")).alias("ties"))
    mean, var = F.col("n") * (F.col("n") + 1) / 4, F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24.0 - F.col("ties") / 48.0
    off = F.col("w_plus") - mean
    z = F.when(var > 0, F.signum(off) * F.greatest(F.abs(off) - 0.5, F.lit(0.0)) / F.sqrt(var)).otherwise(F.lit(0.0))
    return a.select(key, "n", "w_plus", z.alias("z")).withColumn("p", two_sided("z"))


#: Bounds of 32-bit numbers between the values 0, 1, 2, ... of a Poisson variable of mean 1; probabilities are met to 2^-32.
_POISSON = [x for k in range(16) if (x := round(2**32 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)))) < 2**32]


def _poisson(rng: np.random.Generator, n: int) -> np.ndarray:
    u, w = rng.integers(0, 1 << 32, n, dtype=np.uint32), np.zeros(n, np.uint8)
    for x in _POISSON:
        w += u >= np.uint32(x)
    return w


def _signs(rng: np.random.Generator, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(rng.bytes((n + 7) // 8), np.uint8))[:n].view(np.int8) * np.int8(2) - np.int8(1)


def _replicates(df: DataFrame, key: str, value: str, iterations: int, seed: int, draw: Callable, finish: Callable, result: str) -> DataFrame:
    """Per key ``n``, ``mean`` and ``finish`` of the sums over its rows of value times a random weight, and of the weights.

    ``finish`` takes both sums for all iterations, and the plain sum.  A row's weights come from a generator seeded by
    the row's own hash, so they do not depend on partitions.  Rows are laid out in order of keys over range partitions,
    so a task holds the sums of one key at a time; only the first and the last key of a partition may have rows in
    others, and only their sums are shuffled and added up.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(value).cast("double").alias("v"), F.xxhash64(*[F.col(c) for c in df.columns], F.lit(seed)).alias("h"))
    laid = rows.repartitionByRange(2 * shuffle_partitions(df.sparkSession), "k", "h").sortWithinPartitions("k", "h")
    names = [x.split()[0] for x in result.split(", ")]

    def row(k: str | None, n: int, t: float, s: np.ndarray, w: np.ndarray, whole: bool) -> pd.DataFrame:
        done = finish(s, w, t) if whole else [None] * len(names)
        return pd.DataFrame({"k": [k], "n": [n], "t": [t], "s": [None if whole else s], "w": [None if whole else w]} | {c: [x] for c, x in zip(names, done)})

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun = first = False
        for batch in batches:
            for k, v, h in zip(batch["k"].where(batch["k"].notna(), None).tolist(), batch["v"].tolist(), batch["h"].tolist()):
                k = None if k is None or k != k else k
                if not begun or k != at:
                    if begun:
                        yield row(at, n, t, s, w, not first)
                    first, begun = not begun, True
                    at, n, t, s, w = k, 0, 0.0, np.zeros(iterations), np.zeros(iterations)
                weights = draw(np.random.Generator(np.random.SFC64(h & 0xFFFFFFFFFFFFFFFF)), iterations)
                n, t = n + 1, t + v
                s += weights * v
                w += weights
        if begun:
            yield row(at, n, t, s, w, False)

    def added(parts: pd.DataFrame) -> pd.DataFrame:
        k, t = parts["k"].iloc[0], math.fsum(parts["t"])
        return row(None if k is None or k != k else k, int(parts["n"].sum()), t, np.sum(np.stack(list(parts["s"])), axis=0), np.sum(np.stack(list(parts["w"])), axis=0), True)

    schema = f"k string, n long, t double, s array<double>, w array<double>, {result}"
    parts = cut(laid.mapInPandas(partial, schema))
    both = parts.where("s IS NULL").unionByName(parts.where("s IS NOT NULL").groupBy("k").applyInPandas(added, schema))
    return both.select(F.col("k").alias(key), "n", (F.col("t") / F.col("n")).alias("mean"), *names)


def bootstrap_mean(df: DataFrame, key: str, value: str, iterations: int = 500, seed: int = 1) -> DataFrame:
    """``(key, n, mean, low, high)``: the mean and a 95 % percentile interval by Poisson bootstrap.

    Rows should be distinct; equal rows draw equal weights.
    """
    low, high = math.floor(0.025 * (iterations - 1)), math.ceil(0.975 * (iterations - 1))

    def ends(s: np.ndarray, w: np.ndarray, _: float) -> list[float | None]:
        m = np.sort(s[w > 0] / w[w > 0])
        return [float(m[min(x, len(m) - 1)]) if len(m) else None for x in (low, high)]

    return _replicates(df, key, value, iterations, seed, _poisson, ends, "low double, high double")


def sign_flip(df: DataFrame, key: str, value: str, iterations: int = 500, seed: int = 2) -> DataFrame:
    """``(key, n, mean, p)``: permutation test of the mean 0 by random signs, p = (extreme + 1) / (iterations + 1)."""

    def extreme(s: np.ndarray, _: np.ndarray, t: float) -> list[float]:
        return [float((np.count_nonzero(np.abs(s) >= abs(t) - 1e-12 * abs(t)) + 1) / (iterations + 1))]

    return _replicates(df.where(F.col(value) != 0), key, value, iterations, seed, _signs, extreme, "p double")
