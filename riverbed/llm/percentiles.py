"""Percentiles of large numeric columns by exact bisection of value intervals.

All groups start from the same intervals, ``PARTS`` to every power of two of the magnitude, so one pass over the rows
counts them below every midpoint, whatever the range.  The interval that holds a wanted rank is then known, and only the
rows inside such intervals go on, as distinct values with counts: a value that very many rows share is one row.  While an
interval still holds many distinct values it is cut again, at ``CUTS`` - 1 midpoints between its least and greatest
value, and what lies outside of the part with the wanted rank is dropped.  What is left is ranked exactly.

Counts of separate days or partitions add up.  ``value_counts`` is a day's state without loss: from the states of all
days ``exact_percentiles`` gives what it gives for their rows.  ``interval_counts`` is a state of bounded size, from
which ``percentiles_of_counts`` gives bounds that hold the exact percentile.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverbed.operators.ordered import running_totals
from riverbed.session import cut

#: Intervals to a power of two, and parts that an interval is cut into by a later pass.
PARTS, CUTS = 256, 1024
#: Distinct values of an interval from which on it is cut again.
MANY = 10_000
#: Added to the number of an interval, so that those of the least magnitudes are positive too.
_BASE = 1100 * PARTS


def _interval(d: Column) -> Column:
    """The number of a finite double's interval, which never falls as the double rises."""
    size = F.floor(F.log2(F.abs(d)) * PARTS) + _BASE
    return F.when(d > 0, size).when(d < 0, -size).otherwise(F.lit(0).cast("long"))


def _edge(interval: Column, after: bool) -> Column:
    """A double at or beyond the end of an interval, below its values or above them."""
    reach = lambda n, slack: F.pow(F.lit(2.0), (n - _BASE) / PARTS) * slack
    near, far = reach(F.abs(interval), 1 - 1e-9), reach(F.abs(interval) + 1, 1 + 1e-9)
    up, down = (far, -near) if after else (near, -far)
    return F.when(interval > 0, up).when(interval < 0, down).otherwise(F.lit(0.0))


def _finite(df: DataFrame, group: list[str], value: str, weight: str | None = None) -> DataFrame:
    d = F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))))
    v = F.when(d == 0, F.lit(0).cast(df.schema[value].dataType)).otherwise(F.col(value))  # 0.0 and -0.0 are one value
    return rows.select(*[F.col(c).alias(f"g{n}") for n, c in enumerate(group)], v.alias("v"), _interval(d).alias("i"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("m"))


def _same(names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"s{c}")) for c in names], F.lit(True))


def _chosen(counts: DataFrame, keys: list[str], part: str) -> DataFrame:
    """The part of each key's counts that holds its rank, with the rank within it."""
    upto = F.sum("m").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, 0))
    held = counts.withColumn("upto", upto).where("upto >= rank AND upto - m < rank")
    return held.withColumn("rank", F.col("rank") - F.col("upto") + F.col("m")).drop("upto", "m")


def exact_percentiles(df: DataFrame, group: list[str], value: str, permille: list[int], weight: str | None = None) -> DataFrame:
    """``(group..., row_count, p<permille>...)``, one row per group that has a finite value, of the value's own type.

    The percentile p of n values is the value of rank ceil(p n), at least 1, in ascending order (nearest rank), so it
    is a value of the column, exactly: the error bound is 0.  Nulls, NaN and infinities do not count.  A null group
    is a group.  ``weight`` names a column that says how many rows a row stands for, as in ``value_counts``.  Columns of
    ``df`` other than those named do not matter.
    """
    g = [f"g{n}" for n in range(len(group))]
    rows = _finite(df, group, value, weight)
    counts = cut(rows.groupBy(*g, "i").agg(F.sum("m").alias("m")))
    whole = counts.groupBy(*[F.col(c).alias(f"s{c}") for c in g]).agg(F.sum("m").alias("n"))
    ranks = F.explode(F.array(*[F.lit(int(p)) for p in permille])).alias("p")
    asked = counts.join(whole, _same(g)).select(*g, "i", "m", "n", ranks).withColumn("rank", F.greatest(F.lit(1), F.expr("(n * p + 999) div 1000")))
    state = cut(_chosen(asked, [*g, "p"], "i"))
    wanted = state.select(*[F.col(c).alias(f"s{c}") for c in (*g, "i")], "p", "n", "rank")
    left = cut(rows.join(wanted, _same([*g, "i"])).groupBy(*g, "p", "n", "rank", "v").agg(F.sum("m").alias("m")))
    while (cut_again := _narrowed(left, [*g, "p"])) is not None:
        left = cut_again
    ranked = running_totals(left, [*g, "p"], ["v"], ["m"]).where("m_upto >= rank AND m_upto - m < rank")
    wide = ranked.groupBy(*g, "n").agg(*[F.max(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in permille])
    return wide.select(*[F.col(a).alias(b) for a, b in zip(g, group)], F.col("n").alias("row_count"), *[f"p{p}" for p in permille])


def _narrowed(left: DataFrame, keys: list[str]) -> DataFrame | None:
    """One pass over what is left: only the part with the wanted rank of each interval; None where no interval is large.

    An interval whose values are one double (decimals that differ beyond it) cannot be cut and counts as small.
    """
    d = F.col("v").cast("double")
    spans = left.groupBy(*[F.col(c).alias(f"s{c}") for c in keys]).agg(F.count("*").alias("values"), F.min(d).alias("lo"), F.max(d).alias("hi")).where((F.col("values") > MANY) & (F.col("lo") < F.col("hi")))
    spans = cut(spans)
    if not spans.limit(1).count():
        return None
    placed = left.join(spans, _same(keys), "left").withColumn("part", F.coalesce(F.floor((d - F.col("lo")) / (F.col("hi") - F.col("lo")) * (CUTS - 1)), F.lit(0))).select(*left.columns, "part")
    placed = cut(placed)
    held = _chosen(placed.groupBy(*keys, "rank", "part").agg(F.sum("m").alias("m")), keys, "part")
    held = held.select(*[F.col(c).alias(f"s{c}") for c in (*keys, "part")], F.col("rank").alias("rank_in"))
    return cut(placed.join(held, _same([*keys, "part"])).select(*[F.col("rank_in").alias("rank") if c == "rank" else c for c in left.columns]))


def value_counts(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """``(group..., <value>, rows)``: the finite values of each group with how often they occur; adds up over states."""
    g = [f"g{n}" for n in range(len(group))]
    return _finite(df, group, value).groupBy(*g, "v").agg(F.sum("m").alias("rows")).select(*[F.col(a).alias(b) for a, b in zip(g, group)], F.col("v").alias(value), "rows")


def interval_counts(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """``(group..., interval, rows)``: the finite values of each group by the interval that a first pass counts in.

    States of separate partitions or days are combined by ``merge_counts``.  An interval spans less than a part of 1/256
    of its values' magnitude.
    """
    found = _finite(df, group, value).groupBy(*[F.col(f"g{n}").alias(c) for n, c in enumerate(group)], F.col("i").alias("interval"))
    return found.agg(F.sum("m").alias("rows"))


def merge_counts(states: DataFrame, group: list[str]) -> DataFrame:
    return states.groupBy(*group, "interval").agg(F.sum("rows").alias("rows"))


def percentiles_of_counts(state: DataFrame, group: list[str], permille: list[int]) -> DataFrame:
    """``(group..., permille, row_count, at_least, at_most)``: bounds of each exact percentile from merged counts."""
    w = Window.partitionBy(*group)
    upto = F.sum("rows").over(w.orderBy("interval").rowsBetween(Window.unboundedPreceding, 0))
    rows = state.withColumn("upto", upto).withColumn("row_count", F.sum("rows").over(w))
    asked = rows.withColumn("permille", F.explode(F.array(*[F.lit(int(p)) for p in permille])))
    rank = F.greatest(F.lit(1), F.expr("(row_count * permille + 999) div 1000"))
    return asked.where((F.col("upto") >= rank) & (F.col("upto") - F.col("rows") < rank)).select(
        *group, "permille", "row_count", _edge(F.col("interval"), False).alias("at_least"), _edge(F.col("interval"), True).alias("at_most")
    )
