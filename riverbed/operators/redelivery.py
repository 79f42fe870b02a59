"""One delivery of each action from a feed that delivers at least once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.functions.keys import key_hash
from riverbed.operators.components import connected_components
from riverbed.operators.ordered import first_per
from riverbed.session import cut, fresh_path
from riverbed.streaming.ingest import pattern
from riverbed.streaming.seen import delivery_keys, links, stream_links

PAIR = ["id_key", "block", "log"]


def _linked(pairs: DataFrame) -> DataFrame:
    """``(vertex, component)`` of the deliveries of pairs that share the identifier or the position with another pair."""
    by_id = pairs.where("id_key IS NOT NULL").groupBy("id_key").agg(F.count("*").alias("n"), F.min("delivery").alias("v")).where("n > 1").drop("n")
    by_place = pairs.where("block IS NOT NULL").groupBy("block", "log").agg(F.count("*").alias("n"), F.min("delivery").alias("v")).where("n > 1").drop("n")
    edges = pairs.join(by_id, "id_key").select(F.col("delivery").alias("u"), "v").unionByName(pairs.join(by_place, ["block", "log"]).select(F.col("delivery").alias("u"), "v"))
    return connected_components(edges)


def kept_deliveries(pairs: DataFrame) -> DataFrame:
    """``delivery`` of the one delivery kept of each action.

    ``pairs`` holds ``(id_key, block, log, delivery)``, one row per pair of identifiers with its first delivery.
    Deliveries are of one action if they share the identifier or the position, directly or over others.  Pairs
    that share neither with another pair are kept as they are; only the rest goes through components.
    """
    pairs = cut(pairs)
    lost = _linked(pairs).where("vertex <> component").select(F.col("vertex").alias("delivery"))
    return pairs.select("delivery").join(lost, "delivery", "left_anti")


def single_actions(df: DataFrame, columns: list[str], narrow: bool = False, **names: str) -> DataFrame:
    """``columns`` of one row of each action of a table at rest, that of its first delivery.

    The rows go through one shuffle by pair of identifiers, reduced before it; what other pairs of the same action hold
    is then taken out by the few deliveries that components name.  Pairs are a shuffle of their own, so that ``columns``
    need not be kept; with ``narrow`` they are kept with the pairs, for columns that are no wider.  Rows without a
    delivery number are left out.
    """
    rows = first_per(delivery_keys(df, also=[F.struct(*columns).alias("row")], **names), PAIR, ["delivery"])
    rows = cut(rows) if narrow else rows
    pairs = rows.select(*PAIR, "delivery") if narrow else cut(batch_pairs(df, **names))
    lost = _linked(pairs).where("vertex <> component").select(F.col("vertex").alias("delivery"))
    return rows.join(lost, "delivery", "left_anti").select("row.*")


def with_actions(df: DataFrame, also: list[str], **columns: str) -> DataFrame:
    """``(action, also...)`` of each row of ``df``: sixteen bytes that are alike for deliveries of one action only.

    They stand for the pair of identifiers, or for the component of a pair that is linked to others, so that only linked
    pairs are joined to the rows.  Rows without a delivery number have no action.
    """
    keyed = delivery_keys(df, also=also, **columns)
    pairs = cut(keyed.groupBy(*PAIR).agg(F.min("delivery").alias("delivery")))
    linked = pairs.join(_linked(pairs), F.col("delivery") == F.col("vertex")).select(F.col("id_key").alias("__i"), F.col("block").alias("__b"), F.col("log").alias("__l"), "component")
    same = F.col("id_key").eqNullSafe(F.col("__i")) & F.col("block").eqNullSafe(F.col("__b")) & F.col("log").eqNullSafe(F.col("__l"))
    none = F.lit("")
    own = F.concat_ws("|", F.coalesce(F.hex("id_key"), none), F.coalesce(F.col("block").cast("string"), none), F.coalesce(F.col("log").cast("string"), none))
    action = key_hash(F.coalesce(F.col("component").cast("string"), own))
    return keyed.join(linked, same, "left").select(action.alias("action"), *also).unionByName(df.where(F.col(columns.get("delivery_col", "delivery_id")).isNull()).select(F.lit(None).cast("binary").alias("action"), *also))


def batch_pairs(df: DataFrame, **columns: str) -> DataFrame:
    """The pairs of identifiers of a table at rest, each with its first delivery."""
    return delivery_keys(df, **columns).groupBy(*PAIR).agg(F.min("delivery").alias("delivery"))


def streamed_repeats(spark: SparkSession, path: str, *, registry: str | None = None, checkpoint: str | None = None, files: int | None = None, batch_bytes: int = 1 << 30, **options) -> DataFrame:
    """``delivery`` of every delivery of a Parquet feed at ``path`` that is not the first of its action, each once.

    The feed runs through the keyed state of identifiers (see ``streaming.seen``), each row once: with the same
    ``registry`` and ``checkpoint`` a later call reads the files that have come since, and its result holds for all that
    was ever read.  Both are new folders where they are not given.  The links that the state tells of are all that is
    left to chain; a delivery that nothing links is kept.  A row stored twice under one number repeats nothing.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger" if files is None else "maxFilesPerTrigger", str(batch_bytes if files is None else files))
    registry = registry or fresh_path(spark, "registry")
    stream_links(reader.parquet(pattern(path)), registry, checkpoint or fresh_path(spark, "seen"), **options)
    return connected_components(links(spark, registry)).where("vertex <> component").select(F.col("vertex").alias("delivery"))


def repeated_deliveries(df: DataFrame, kept: DataFrame, delivery_col: str = "delivery_id") -> DataFrame:
    """The numbers of all deliveries of ``df`` that ``kept`` does not hold, each once."""
    return df.where(F.col(delivery_col).isNotNull()).select(F.col(delivery_col).cast("long").alias(delivery_col)).join(kept.select(F.col("delivery").alias(delivery_col)), delivery_col, "left_anti").distinct()


def single_deliveries(df: DataFrame, kept: DataFrame, delivery_col: str = "delivery_id") -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns; a row stored twice under one number comes out once."""
    return df.join(kept.select(F.col("delivery").alias(delivery_col)), delivery_col, "left_semi").dropDuplicates([delivery_col])


def without_repeats(df: DataFrame, repeats: DataFrame, delivery_col: str = "delivery_id") -> DataFrame:
    """The rows of ``df`` whose delivery is none of ``repeats``; a row stored twice under one number comes out once."""
    return df.where(F.col(delivery_col).isNotNull()).join(repeats.select(F.col("delivery").alias(delivery_col)), delivery_col, "left_anti").dropDuplicates([delivery_col])
