"""Measures of curves given by points: area under it and the depth at which it passes a threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def curve_measures(df: DataFrame, key: list[str], x: str, y: str, thresholds: list[float]) -> DataFrame:
    """``(key..., points, reach, area, depth_<threshold>, breached_<threshold>)`` of each curve.

    A curve starts at (0, 0) and is linear between points in the order of ``x``; points with a null are left out.
    ``area`` is that under it over its reach.  ``depth`` is where it first exceeds the threshold, its reach where it
    never does; a threshold of 0 or less is breached at 0.  Curves should be of bounded length, such as a state's.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    w = Window.partitionBy(*key).orderBy("x", "y")
    steps = rows.withColumns({"x0": F.lag("x", 1, 0.0).over(w), "y0": F.lag("y", 1, 0.0).over(w)})
    reach = F.max("x")
    out = [F.count("*").alias("points"), reach.alias("reach"), F.coalesce(F.try_divide(F.sum((F.col("x") - F.col("x0")) * (F.col("y") + F.col("y0")) / 2), F.when(reach > 0, reach)), F.lit(0.0)).alias("area")]
    for t in thresholds:
        name = f"{t:g}".replace(".", "_")
        if t <= 0:
            out += [F.lit(0.0).alias(f"depth_{name}"), F.lit(True).alias(f"breached_{name}")]
            continue
        part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.lit(t) - F.col("y0"), F.col("y") - F.col("y0"))))
        at = F.when(F.col("y") > t, F.col("x0") + (F.col("x") - F.col("x0")) * F.coalesce(part, F.lit(0.0)))
        first = F.min_by(at, F.when(at.isNotNull(), F.struct("x", "y")))
        out += [F.coalesce(first, reach).alias(f"depth_{name}"), first.isNotNull().alias(f"breached_{name}")]
    return steps.groupBy(*key).agg(*out)
