"""Sums of whole numbers of any length, kept as text, in limbs of 18 digits that Spark adds natively."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 18


def _digits(text: Column) -> Column:
    return F.regexp_replace(F.btrim(text), r"^[-+]?0*(?=[0-9])", "")


def _whole(text: Column) -> Column:
    return F.btrim(text).rlike(r"^[-+]?[0-9]+$")


def limbs_needed(df: DataFrame, column: str) -> int:
    """Limbs that the longest whole number of a column takes, 1 at least."""
    most = df.agg(F.max(F.when(_whole(F.col(column)), F.length(_digits(F.col(column)))))).first()[0] or 1
    return -(-most // WIDTH)


def limbs(text: Column, count: int) -> list[Column]:
    """The signed limbs of a decimal text, lowest first; null for null and for what is no whole number.

    A number too long for ``count`` limbs fails the query: use ``limbs_needed``.
    """
    digits = _digits(text)
    sign = F.when(F.btrim(text).startswith("-"), -1).otherwise(1)
    fits = F.when(F.length(digits) <= WIDTH * count, digits).otherwise(F.raise_error(F.lit("more digits than limbs")))
    padded = F.lpad(fits, WIDTH * count, "0")
    return [F.when(_whole(text), F.substring(padded, WIDTH * (count - 1 - i) + 1, WIDTH).cast("long") * sign) for i in range(count)]


def sum_limbs(text: Column, count: int) -> list[Column]:
    """Aggregates that add each limb; combine them by ``text_of``."""
    return [F.sum(x.cast("decimal(38,0)")) for x in limbs(text, count)]


@F.pandas_udf(T.StringType())
def _joined(parts: pd.Series) -> pd.Series:
    return parts.map(lambda ls: None if ls is None or any(x is None for x in ls) else str(sum(int(x) * 10 ** (WIDTH * i) for i, x in enumerate(ls))))


def text_of(parts: list[Column]) -> Column:
    """The decimal text of summed limbs, one per group; null where a group has no number."""
    return _joined(F.array(*parts))
