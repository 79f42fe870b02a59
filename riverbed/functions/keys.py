"""Canonical spelling of addresses and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as surrounding white space in identifiers (fixed values).
BLANKS = " \t\r\n"


def clean_key(c: Column | str) -> Column:
    """Lower case without surrounding white space; null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.btrim(c, F.lit(BLANKS))), F.lit(""))


def clean_address(c: Column | str) -> Column:
    """``0x`` and the hexadecimal digits in lower case; null where nothing is left."""
    key = clean_key(c)
    return F.when(key.startswith("0x"), key).when(key.isNotNull(), F.concat(F.lit("0x"), key))


def key_hash(c: Column) -> Column:
    """Sixteen bytes that stand for a string key in shuffles and state; null for null."""
    return F.unhex(F.md5(c.cast("binary")))
