"""Scalar expressions: ratios with guarded denominators, exact scaling, hashes, labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tick spacing by fee tier (fixed values).
SPACING = {100: 1, 500: 10, 3000: 60, 10000: 200}


def spacing_of(fee: Column) -> Column:
    """Tick spacing of a fee tier; null for an unknown one."""
    out = F.lit(None).cast("int")
    for tier, width in SPACING.items():
        out = F.when(fee == tier, F.lit(width)).otherwise(out)
    return out


def ratio(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """``scale * part / whole``, 0 where the denominator is null or not positive."""
    return F.when(whole > 0, part.cast("double") * scale / whole.cast("double")).otherwise(F.lit(0.0))


def log1p_of(v: Column) -> Column:
    """log(1 + v), 0 where v is null, NaN or not positive."""
    v = v.cast("double")
    return F.when((v > 0) & ~F.isnan(v), F.log1p(v)).otherwise(F.lit(0.0))


def location(tick: Column, lower: Column, upper: Column) -> Column:
    """Where the current tick lies: below a range, above it (the upper bound is outside), or in it."""
    return F.when(tick < lower, "below_current_tick").when(tick >= upper, "above_current_tick").when(tick.isNotNull() & lower.isNotNull() & upper.isNotNull(), "active")


def outside(tick: Column, lower: Column, upper: Column) -> Column:
    """Distance of the tick from the range, 0 inside."""
    return F.when(tick < lower, lower - tick).when(tick >= upper, tick - upper).when(tick.isNotNull() & lower.isNotNull() & upper.isNotNull(), F.lit(0))


def direction(amount0: Column, amount1: Column) -> Column:
    """The token that came in: 0 for 1, 1 for 0; null where neither or both did."""
    return F.when((amount0 > 0) & (amount1 <= 0), "zero_for_one").when((amount1 > 0) & (amount0 <= 0), "one_for_zero")


def slug(c: Column) -> Column:
    """Lower-case letters and digits joined by single underscores; ``pool`` where nothing is left."""
    s = F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("pool")).otherwise(s)


def seeded_score(seed: int, key: Column) -> Column:
    """A reproducible order of keys: SHA-256 of the seed in eight bytes and the key, in hexadecimal."""
    return F.sha2(F.concat(F.lit(seed.to_bytes(8, "big")), F.encode(key, "UTF-8")), 256)


def scaled(raw: Column, decimals: Column) -> Column:
    """A raw token amount in units of the token, to 18 places."""
    return (raw.cast("double") / F.pow(F.lit(10.0), decimals.cast("double"))).cast("double")


def block_bin(block: Column, first: Column, last: Column, bins: int) -> Column:
    """Number of the equal part of [first, last] that a block lies in, 0 to bins - 1."""
    return F.least(F.lit(bins - 1).cast("long"), F.floor((block - first) * bins / (last - first + 1)).cast("long"))


@F.pandas_udf(T.LongType())
def fnv1a(text: pd.Series) -> pd.Series:
    """FNV-1a of 64 bits over a text, without its sign bit; null for null."""

    def one(t):
        if t is None:
            return None
        h = 0xCBF29CE484222325
        for byte in t.encode():
            h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return h & 0x7FFFFFFFFFFFFFFF

    return text.map(one).astype("Int64")
