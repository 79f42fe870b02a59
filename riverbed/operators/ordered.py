"""Operators over ordered rows: running totals, as-of joins, bounded look-around, pages.

Keys are skewed, so nothing here sorts a whole key in one task.  Running totals use exact offsets of range
partitions; as-of joins and look-around cut the position (a block number) into buckets, so that work is keyed by
(key, bucket), and carry over bucket borders what the neighbours need to know.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverbed.session import cut, shuffle_partitions


def running_totals(df: DataFrame, key: list[str], order: list[str], amounts: list[str], suffix: str = "_upto", how: Callable[..., Column] = F.sum, also_max: list[str] | None = None) -> DataFrame:
    """``df`` with ``<amount>_upto``: the sum within ``key`` up to and with each row in the order of ``order``.

    ``how`` may be ``F.max`` for the greatest value so far instead; ``also_max`` names columns of which the greatest value
    so far comes out besides sums.  Null amounts count as 0 in sums and not at all in maxima; a null key is a key like
    others.  Rows that ``order`` does not tell apart are taken in any order.
    """
    wanted = [(a, how) for a in amounts] + [(a, F.max) for a in also_max or []]
    value = lambda a, f: F.coalesce(F.col(a), F.lit(0)) if f is F.sum else F.col(a)
    laid = cut(df.repartitionByRange(2 * shuffle_partitions(df.sparkSession), *key, *order).withColumn("__part", F.spark_partition_id()))
    totals = laid.groupBy("__part", *key).agg(*[f(value(a, f)).alias(f"__s{i}") for i, (a, f) in enumerate(wanted)])
    before = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], *[f(f"__s{i}").over(before).alias(f"__b{i}") for i, (_, f) in enumerate(wanted)])
    here = Window.partitionBy("__part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = laid.withColumns({f"__h{i}": f(value(a, f)).over(here) for i, (a, f) in enumerate(wanted)})
    on = F.col("__part") == F.col("__p")
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    whole = {f"{a}{suffix}": F.col(f"__h{i}") + F.coalesce(F.col(f"__b{i}"), F.lit(0)) if f is F.sum else F.greatest(f"__h{i}", f"__b{i}") for i, (a, f) in enumerate(wanted)}
    return rows.join(offsets, on).withColumns(whole).select(*df.columns, *whole)


def range_extremes(df: DataFrame, key: str, number: str, values: list[str], asked: DataFrame, first: str, last: str, block: int = 64) -> DataFrame:
    """``asked`` with ``<value>_least`` and ``<value>_most`` over the rows of its key numbered ``first`` to ``last``.

    ``df`` numbers the rows of each key 0, 1, 2, ...; ``asked`` has a column ``key`` too and may ask for any ranges, also
    overlapping and very long ones.  Rows of ``block`` numbers lie in one array each; over the blocks there is a row per
    block and power of two with the extremes of so many blocks from there on.  A range is at most two pieces of blocks
    and two powers that overlap, so each asked row becomes at most four look-ups.  Null where the range is empty or null.
    """
    low, high = [f"__lo{i}" for i in range(len(values))], [f"__hi{i}" for i in range(len(values))]
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("__k"), F.col(number).alias("__n"), *[F.col(v).alias(f"__v{i}") for i, v in enumerate(values)])
    ends_of = [x for i in range(len(values)) for x in (F.min(f"__v{i}").alias(low[i]), F.max(f"__v{i}").alias(high[i]))]
    blocks = cut(rows.groupBy("__k", F.floor(F.col("__n") / block).alias("__at")).agg(F.collect_list(F.struct("__n", *[f"__v{i}" for i in range(len(values))])).alias("__r"), *ends_of))
    ids = cut(asked.withColumn("__id", F.monotonically_increasing_id()))
    a, b = F.floor(F.col(first) / block), F.floor(F.col(last) / block)
    spans = ids.where(F.col(key).isNotNull() & (F.col(first) <= F.col(last))).select("__id", F.col(key).alias("__k"), F.col(first).alias("__f"), F.col(last).alias("__l"), a.alias("__a"), b.alias("__b"))
    widest = spans.agg(F.max(F.col("__b") - F.col("__a") - 1)).first()[0] or 0
    ends = spans.select("__id", "__k", "__f", "__l", F.explode(F.array_distinct(F.array("__a", "__b"))).alias("__at"))
    own = F.filter("__r", lambda r: (r["__n"] >= F.col("__f")) & (r["__n"] <= F.col("__l"))).alias("__own")
    pieces = ends.join(blocks.select("__k", "__at", "__r"), ["__k", "__at"]).select("__id", own)
    found = pieces.select("__id", *[f(F.col(f"__own.__v{i}")).alias(names[i]) for i in range(len(values)) for f, names in ((F.array_min, low), (F.array_max, high))])
    level, size = blocks.drop("__r"), 1
    inner = spans.withColumn("__w", F.col("__b") - F.col("__a") - 1).where("__w > 0")
    while size <= widest:
        due = inner.where((F.col("__w") >= size) & (F.col("__w") < 2 * size)).select("__id", "__k", F.explode(F.array_distinct(F.array(F.col("__a") + 1, F.col("__b") - size))).alias("__at"))
        found = found.unionByName(due.join(level, ["__k", "__at"]).select("__id", *[c for p in zip(low, high) for c in p]))
        later = level.select("__k", (F.col("__at") - size).alias("__at"), *[F.col(c).alias(f"{c}_") for c in low + high])
        level = cut(level.join(later, ["__k", "__at"], "left").select("__k", "__at", *[F.least(c, f"{c}_").alias(c) for c in low], *[F.greatest(c, f"{c}_").alias(c) for c in high]))
        size *= 2
    best = found.groupBy("__id").agg(*[x for i, v in enumerate(values) for x in (F.min(low[i]).alias(f"{v}_least"), F.max(high[i]).alias(f"{v}_most"))])
    return ids.join(best, "__id", "left").drop("__id")


def asof(left: DataFrame, right: DataFrame, key: str, position: str, payload: str, width: int = 4096, out: str = "state") -> DataFrame:
    """``left`` with ``out``: ``payload`` of the last row of ``right`` with the same key at or before its position.

    Of several rows of ``right`` at one position the greatest payload counts.  Null where there is none, or where key
    or position is null.  Within a bucket of ``width`` positions the rows are merged in order; before the first row
    of a bucket the last state of the buckets before it holds, found over one row per key and bucket.
    """
    states = right.where(F.col(key).isNotNull() & F.col(position).isNotNull()).groupBy(F.col(key).alias("__k"), F.col(position).cast("long").alias("__t")).agg(F.max(payload).alias("__v"))
    bucket = F.floor(F.col("__t") / width).alias("__bucket")
    row = F.struct("__t", "__v")
    last = states.groupBy("__k", bucket).agg(F.max(row).alias("__last"))
    rows = left.drop(out).withColumns({"__t": F.col(position).cast("long"), "__k": F.col(key)})
    asked = rows.select("__k", bucket).where("__k IS NOT NULL AND __bucket IS NOT NULL").distinct()
    spans = asked.join(last, ["__k", "__bucket"], "full")
    carry = F.last("__last", ignorenulls=True).over(Window.partitionBy("__k").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = spans.withColumn("__carry", carry).select("__k", "__bucket", "__carry")
    wanted = rows.select("__k", "__t").where("__k IS NOT NULL AND __t IS NOT NULL").distinct().withColumn("__v", F.lit(None).cast(states.schema["__v"].dataType)).withColumn("__ask", F.lit(1))
    merged = wanted.unionByName(states.withColumn("__ask", F.lit(0))).withColumn("__bucket", F.floor(F.col("__t") / width))
    upto = Window.partitionBy("__k", "__bucket").orderBy("__t", "__ask").rowsBetween(Window.unboundedPreceding, 0)
    found = merged.withColumn("__seen", F.last(F.when(F.col("__ask") == 0, row), ignorenulls=True).over(upto)).where("__ask = 1")
    known = found.join(carried, ["__k", "__bucket"], "left").select("__k", "__t", F.coalesce("__seen", "__carry").alias("__found"))
    return rows.join(known, ["__k", "__t"], "left").withColumn(out, F.col("__found.__v")).select(*left.drop(out).columns, out)


def haloed(df: DataFrame, key: str, position: str, width: int, back: int = 0, ahead: int = 0) -> DataFrame:
    """``df`` with ``bucket`` and ``own``: each row in its bucket, and again in those that look ``back`` or ``ahead`` to it.

    A row at p is seen from positions in [p - ahead, p + back], so it goes to all buckets that these touch; ``own`` is
    true in its own.  Windows over (key, bucket) then see all that lies within reach.  ``width`` should be at least
    the reach.  Rows with a null position are left out.
    """
    p = F.col(position).cast("long")
    spread = F.explode(F.sequence(F.floor((p - ahead) / width), F.floor((p + back) / width)))
    return df.where(F.col(position).isNotNull()).withColumn("bucket", spread).withColumn("own", F.col("bucket") == F.floor(p / width))


def neighbours(df: DataFrame, key: str, position: str, reach: int) -> DataFrame:
    """``df`` with ``near``: whether another row of the key lies within ``reach`` positions; at the same place counts.

    Rows at one position are counted first, so a bucket holds no more than its positions.  Rows whose key or position
    is null have none near them.
    """
    places = df.where(F.col(key).isNotNull() & F.col(position).isNotNull()).groupBy(F.col(key).alias("__k"), F.col(position).cast("long").alias("__p")).agg(F.count("*").alias("__n"))
    rows = haloed(places, "__k", "__p", max(1024, 2 * reach), reach, reach)
    w = Window.partitionBy("__k", "bucket").orderBy("__p").rangeBetween(-reach, reach)
    crowd = rows.withColumn("__crowd", F.sum("__n").over(w)).where("own").select("__k", "__p", "__crowd")
    on = (F.col(key) == F.col("__k")) & (F.col(position).cast("long") == F.col("__p"))
    return df.join(crowd, on, "left").withColumn("near", F.coalesce(F.col("__crowd") > 1, F.lit(False))).select(*df.columns, "near")


def cursor(block: str = "block_number", log: str = "log_index") -> Column:
    """The place of an event: block, then position in the block; compares in that order."""
    return F.struct(F.col(block).cast("long").alias("block"), F.col(log).cast("int").alias("log"))


def after_cursor(block: int, log: int, through: int | None = None, block_col: str = "block_number", log_col: str = "log_index") -> Column:
    """Rows after a cursor and up to the end of block ``through``; bounds on the block alone come first, for pruning."""
    b, n = F.col(block_col), F.col(log_col)
    bound = (b >= block) & ((b > block) | (n > log))
    return bound if through is None else bound & (b <= through)


def first_per(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in the order given."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rn = 1").drop("__rn")


def conflicts(df: DataFrame, key: list[str], payload: list[str], first: tuple[str, list[str]] | None = None) -> DataFrame:
    """``(key..., copies, versions)`` of each key stored more than once; more than one version is a conflict.

    Null is a value like others in the payload.  ``first`` names a column and others that go with its least value: all
    of them come out as they are in the row where it is least.
    """
    content = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in payload])
    row = [F.min(F.struct(first[0], *first[1])).alias("__row")] if first else []
    seen = df.groupBy(*key, content.alias("__content")).agg(F.count("*").alias("__n"), *row)
    both = seen.groupBy(*key).agg(F.sum("__n").alias("copies"), F.count("*").alias("versions"), *[F.min("__row").alias("__row") for _ in row]).where("copies > 1")
    return both.select(*key, "copies", "versions", *(["__row.*"] if first else []))
