"""Exact sums of doubles and of big integers that no native type holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LIMB = 4294967296


def finite(c: Column | str) -> Column:
    """The number, or null where it is null, NaN or infinite."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


#: Amounts of this size and more are beyond an exact sum of cents in 38 digits.
BEYOND = 1e26


def too_large(c: Column | str) -> Column:
    """Whether a finite number is too large for ``exact_cents``; false for null, NaN and infinities."""
    return F.coalesce(F.abs(finite(c)) >= BEYOND, F.lit(False))


def exact_cents(c: Column | str) -> Column:
    """A finite double below 1e26, in whole hundredths, as a decimal whose sums depend on no order.

    Null for other numbers; ``too_large`` tells those that are finite, so that they can be reported.
    """
    cents = F.rint(F.when(~too_large(c), finite(c)) * 100)
    high = F.floor(cents / float(_LIMB))
    low = cents - high.cast("double") * float(_LIMB)
    return (high.cast("decimal(20,0)") * F.lit(_LIMB).cast("decimal(10,0)") + low.cast("long").cast("decimal(12,0)")).cast("decimal(36,0)")


def mean_down(c: Column | str) -> Column:
    """The mean of numbers with up to six decimal places, rounded down to six: from an exact sum, whatever the order."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(F.sum(F.round(c.cast("double") * 1_000_000).cast("long")) / F.count(c)) / 1_000_000


def mean_down_sql(c: str) -> str:
    return f"floor(sum(CAST(round(CAST({c} AS DOUBLE) * 1000000) AS BIGINT)) / count({c})) / 1000000"
