"""Sinks: tables keyed by window or by row, single CSV and JSON files; each replaces what it writes in one step."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.operators.ordered import first_per
from riverbed.session import cut


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at(path))


def append_window(df: DataFrame, path: str, first: int, last: int, block: str = "block_number") -> None:
    """Add the blocks [first, last] of a feed to a table of windows.

    A window is a folder of its own, so running it again replaces it and nothing is stored twice.  Windows must join:
    raises ValueError where the one before does not end at ``first - 1``, or where a row lies outside the window.
    """
    spark = df.sparkSession
    if exists(spark, path):
        others = spark.read.parquet(path).where((F.col("window_first") != first) | (F.col("window_last") != last))
        before = others.where(F.col("window_first") < first).agg(F.max("window_last")).first()[0]
        if before is not None and before != first - 1:
            raise ValueError(f"window starts at {first}, not at {before + 1}")
    if df.where(~F.coalesce(F.col(block).between(first, last), F.lit(False))).limit(1).count():
        raise ValueError(f"rows outside [{first}, {last}]")
    df.write.mode("overwrite").parquet(f"{path}/window_first={first}/window_last={last}")


def insert_ignore(df: DataFrame, path: str, key: list[str]) -> int:
    """Append the rows whose key the table lacks, one of each key, the least by all its columns; returns how many.

    A table has one writer at a time.
    """
    spark = df.sparkSession
    new = first_per(df, key, df.columns)
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select(*key), key, "left_anti").select(*df.columns)
    new = cut(new)
    new.write.mode("append").parquet(path)
    return new.count()


def upsert(df: DataFrame, path: str, key: list[str], latest: list[str | Column], target: str) -> None:
    """Write to ``target`` the table at ``path`` with the rows of ``df`` merged in: the first by ``latest`` of each key."""
    spark = df.sparkSession
    both = spark.read.parquet(path).unionByName(df) if exists(spark, path) else df
    first_per(both, key, latest).write.mode("overwrite").parquet(target)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """A report as one CSV file with a header, complete or not there at all.

    A task streams the sorted rows to a folder beside the file, which is then renamed; nothing passes the driver.
    """
    spark = df.sparkSession
    part = f"{path}.part-{uuid.uuid4().hex}"
    df.orderBy(*order).coalesce(1).write.csv(part, header=True, emptyValue='""')
    fs, at = _file_system(spark, path)
    made = [f.getPath() for f in fs.listStatus(at(part)) if f.getPath().getName().endswith(".csv")]
    fs.delete(at(path), False)
    fs.rename(made[0], at(path))
    fs.delete(at(part), True)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small document, indented, complete or not there at all, in the file system that the path names."""
    fs, at = _file_system(spark, path)
    part = at(f"{path}.part-{uuid.uuid4().hex}")
    out = fs.create(part)
    out.write(bytearray(json.dumps(value, indent=2, sort_keys=True).encode()))
    out.close()
    fs.delete(at(path), False)
    fs.rename(part, at(path))
