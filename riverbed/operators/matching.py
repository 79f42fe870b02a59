"""Reproducible sampling and matching of events.

Greedy choices depend on the choices before them.  Matching is therefore done stratum by stratum, where a stratum is what
its key says, whole: the positions of one state of a pool, say.  The key should name what is of bounded size by its
nature; a hot pool then has many strata, never a large one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from riverbed.functions.scalars import block_bin, seeded_score
from riverbed.operators.chunks import number_rows
from riverbed.operators.ordered import asof
from riverbed.session import cut


def stratified_order(df: DataFrame, key: str, block: str, name: Column, order: list[str], bins: int, seed: int) -> DataFrame:
    """``df`` with ``bin``, ``round`` and ``place``: every bin of a key's blocks in turn gives its next row.

    Within a bin rows come in the order of a hash of ``seed`` and ``name``, then of ``order``; ``round`` counts from 1.
    ``place`` is the row's place in its key's whole sequence: round by round, bin by bin.
    """
    spans = df.groupBy(key).agg(F.min(block).alias("__lo"), F.max(block).alias("__hi"))
    rows = df.join(spans, key).withColumn("bin", block_bin(F.col(block), F.col("__lo"), F.col("__hi"), bins)).withColumn("__score", seeded_score(seed, name)).drop("__lo", "__hi")
    cells = number_rows(rows.withColumn("__cell", F.struct(key, "bin")), "__cell", ["__score", *order])
    drawn = cells.withColumn("round", F.col("row_in_key") + 1).drop("__score", "__cell", "row_in_key")
    return number_rows(drawn, key, ["round", "bin"]).withColumnRenamed("row_in_key", "place")


def spaced(df: DataFrame, key: str, position: str, spacing: int, cells: int = 256) -> DataFrame:
    """``(key, position)``: from each key's least position on, the next one at least ``spacing`` after the last taken.

    A chain is sequential, but it can be cut: where it leaves a chunk of ``cells`` times ``spacing`` positions depends only
    on where it came in, which is at one of the chunk's first ``spacing`` positions or the first after them.  So each
    chunk tells for all these where a chain from there leaves it; the entries that the key's chain reaches are then
    found by jumps of doubled length over entries alone, and each chunk that it passes lists its positions.  Rows with a
    null key or position are left out.
    """
    width = spacing * cells
    kind = df.schema[key].dataType.simpleString()
    rows = cut(df.where(F.col(key).isNotNull() & F.col(position).isNotNull()).select(F.col(key).alias("k"), F.col(position).cast("long").alias("p")).distinct().withColumn("chunk", F.floor(F.col("p") / width)))

    def exits(rows: pd.DataFrame) -> pd.DataFrame:
        p = np.sort(rows["p"].to_numpy())
        ahead = np.searchsorted(p, p + spacing)
        last = np.arange(len(p))
        for i in range(len(p) - 1, -1, -1):
            if ahead[i] < len(p):
                last[i] = last[ahead[i]]
        n = min(len(p), int(np.searchsorted(p, p[0] // width * width + spacing)) + 1)
        return pd.DataFrame({"k": [rows["k"].iloc[0]] * n, "p": p[:n], "bound": p[last[:n]] + spacing})

    entries = cut(rows.groupBy("k", "chunk").applyInPandas(exits, f"k {kind}, p long, bound long"))
    back = asof(entries.select("k", "p", (-F.col("bound")).alias("at")), entries.select("k", (-F.col("p")).alias("at"), F.col("p").alias("to")), "k", "at", "to", width=width, out="to")
    jump = cut(back.where("to IS NOT NULL").select("k", "p", "to"))
    reached = cut(entries.groupBy("k").agg(F.min("p").alias("p")))
    while jump.limit(1).count():
        reached = cut(reached.unionByName(reached.join(jump, ["k", "p"]).select("k", F.col("to").alias("p"))).distinct())
        jump = cut(jump.join(jump.select("k", F.col("p").alias("to"), F.col("to").alias("beyond")), ["k", "to"]).select("k", "p", F.col("beyond").alias("to")))
    passed = reached.select("k", F.floor(F.col("p") / width).alias("chunk"), F.col("p").alias("entry"))

    def listed(rows: pd.DataFrame) -> pd.DataFrame:
        p, at, taken = np.sort(rows["p"].to_numpy()), int(rows["entry"].iloc[0]), []
        while (i := int(np.searchsorted(p, at))) < len(p):
            taken.append(p[i])
            at = p[i] + spacing
        return pd.DataFrame({key: [rows["k"].iloc[0]] * len(taken), position: taken})

    return rows.join(passed, ["k", "chunk"]).groupBy("k", "chunk").applyInPandas(listed, f"{key} {kind}, {position} long")


def pair_cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` from all rows of ``b``."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        total += np.subtract.outer(a[:, i], b[:, i]) ** 2
    return np.sqrt(total)


def improve(cost: np.ndarray, partner: np.ndarray) -> np.ndarray:
    """Swap partners of two pairs while that lowers the sum of costs."""
    partner, better = partner.copy(), True
    while better:
        better = False
        for i in range(len(partner)):
            for j in range(i + 1, len(partner)):
                now = cost[i, partner[i]] + cost[j, partner[j]]
                if cost[i, partner[j]] + cost[j, partner[i]] < now - 1e-12:
                    partner[i], partner[j] = partner[j], partner[i]
                    better = True
    return partner


def _strata(df: DataFrame, key: list[str], name: str, treated: str, features: list[str], at: str | None = None) -> GroupedData:
    return df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.col(name).cast("string").alias("__name"), F.coalesce(F.col(treated), F.lit(False)).alias("__treated"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"__f{i}") for i, f in enumerate(features)], *([F.col(at).cast("long").alias("__at")] if at else [])).groupBy(*[f"__k{i}" for i in range(len(key))])


def _scaled(rows: pd.DataFrame, n: int) -> np.ndarray:
    x = rows[[f"__f{i}" for i in range(n)]].to_numpy()
    spread = x.std(0, ddof=1) if len(x) > 1 else np.ones(n)
    return x / np.where((spread > 0) & np.isfinite(spread), spread, 1.0)


def matched(df: DataFrame, key: list[str], name: str, treated: str, features: list[str], caliper: float) -> DataFrame:
    """``(name, control, distance)``: a control for each treated row of its stratum, one to one, within ``caliper``.

    A stratum is all rows with the same ``key``.  Features are scaled by their standard deviation in the stratum (1 where
    nothing varies), nulls are 0.  The treated row whose best control is farthest chooses first; then partners are
    swapped while the sum of distances falls.  Treated rows without a free control within the caliper stay out.
    """
    none = pd.DataFrame({"a": pd.Series([], dtype=object), "b": pd.Series([], dtype=object), "d": pd.Series([], dtype=float)})

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__name", ignore_index=True)
        x = _scaled(rows, len(features))
        t, c = np.flatnonzero(rows["__treated"]), np.flatnonzero(~rows["__treated"])
        if not len(t) or not len(c):
            return none
        cost = pair_cost(x[t], x[c])
        free, pairs = np.ones(len(c), bool), []
        for i in np.argsort(-cost.min(1), kind="stable"):
            j = int(np.where(free, cost[i], np.inf).argmin())
            if free[j] and cost[i, j] <= caliper:
                free[j] = False
                pairs.append((int(i), j))
        if not pairs:
            return none
        own = cost[[i for i, _ in pairs]]
        partner = improve(np.where(own <= caliper, own, np.inf), np.array([j for _, j in pairs]))
        names = rows["__name"].to_numpy()
        return pd.DataFrame({"a": names[t[[i for i, _ in pairs]]], "b": names[c[partner]], "d": own[np.arange(len(pairs)), partner]})

    found = _strata(df, key, name, treated, features).applyInPandas(match, "a string, b string, d double")
    return found.select(F.col("a").alias(name), F.col("b").alias("control"), F.col("d").alias("distance"))


def controls(df: DataFrame, key: list[str], name: str, treated: str, features: list[str], caliper: float, per: int = 3, reuse: int = 3, apart: tuple[str, int] | None = None) -> DataFrame:
    """``(name, control, choice, distance)``: up to ``per`` controls for each treated row, each used up to ``reuse`` times.

    ``apart`` names a position and how far from a treated row its controls must at least be there.
    Strata, scaling and nulls as in ``matched``.  Treated rows with the fewest controls within the caliper choose
    first, of these the one whose nearest is farthest, then by name; each takes its nearest controls that are still
    to be had.
    """
    none = pd.DataFrame({"a": pd.Series([], dtype=object), "b": pd.Series([], dtype=object), "n": pd.Series([], dtype="int64"), "d": pd.Series([], dtype=float)})

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__name", ignore_index=True)
        x = _scaled(rows, len(features))
        t, c = np.flatnonzero(rows["__treated"]), np.flatnonzero(~rows["__treated"])
        if not len(t) or not len(c):
            return none
        cost, uses, names, out = pair_cost(x[t], x[c]), np.zeros(len(c), int), rows["__name"].to_numpy(), []
        if apart:
            at = rows["__at"].to_numpy()
            cost[np.abs(np.subtract.outer(at[t], at[c])) < apart[1]] = np.inf
        for i in np.lexsort((names[t].astype(str), -cost.min(1), (cost <= caliper).sum(1))):
            near = [j for j in np.argsort(cost[i], kind="stable") if cost[i, j] <= caliper and uses[j] < reuse][:per]
            uses[near] += 1
            out += [(names[t[i]], names[c[j]], n + 1, float(cost[i, j])) for n, j in enumerate(near)]
        return pd.DataFrame(out, columns=["a", "b", "n", "d"]) if out else none

    found = _strata(df, key, name, treated, features, apart[0] if apart else None).applyInPandas(choose, "a string, b string, n long, d double")
    return found.select(F.col("a").alias(name), F.col("b").alias("control"), F.col("n").alias("choice"), F.col("d").alias("distance"))
