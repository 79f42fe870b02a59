"""Connected components by contraction under changing orders.

In a round every vertex moves to the neighbour that comes first in that round's order, itself included; edges then join
the places that their ends moved to, and what has become a loop or a copy is gone.  A component that has shrunk to one
vertex has no edge left and takes no part in later rounds.  The first two rounds order by the vertices themselves, which
settles the stars around a least vertex that most components are; later rounds take random orders, so that chains, too,
get shorter by a constant share on average.  The moves are composed afterwards, last round first.

The least neighbour is reduced map-side, so a vertex with very many neighbours is one row per partition, and the joins
that move edges hold one row per vertex on one side and are split by adaptive skew handling on the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.session import cut


def _moves(edges: DataFrame, turn: int) -> DataFrame:
    """``(vertex, place)`` of every vertex that an edge touches."""
    both = edges.select(F.col("u").alias("vertex"), F.col("v").alias("other")).unionByName(edges.select(F.col("v").alias("vertex"), F.col("u").alias("other")))
    order = (lambda c: F.xxhash64(F.lit(turn), c)) if turn > 1 else F.col
    near = both.groupBy("vertex").agg(F.min_by("other", order("other")).alias("near"))
    return near.select("vertex", F.when(order("vertex") < order("near"), F.col("vertex")).otherwise(F.col("near")).alias("place"))


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(vertex, component)`` for every vertex that has an edge; the component is its smallest vertex.

    ``edges`` holds the long columns ``u`` and ``v``.  Rows with a null on either side and self loops link nothing
    and are left out.  An empty input gives an empty result.
    """
    left = cut(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    rounds: list[DataFrame] = []
    while left.limit(1).count():
        if len(rounds) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        moved = cut(_moves(left, len(rounds)))
        a, b = moved.select(F.col("vertex").alias("u"), F.col("place").alias("a")), moved.select(F.col("vertex").alias("v"), F.col("place").alias("b"))
        rounds.append(moved)
        left = cut(left.join(a, "u").join(b, "v").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if not rounds:
        return left.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    found = rounds.pop()
    while rounds:
        # a place without an edge of its own in the next round is where its vertices stay
        later = found.select(F.col("vertex").alias("place"), F.col("place").alias("last"))
        found = cut(rounds.pop().join(later, "place", "left").select("vertex", F.coalesce("last", "place").alias("place")))
    least = found.groupBy("place").agg(F.min("vertex").alias("component"))
    return found.join(least, "place").select("vertex", "component")
