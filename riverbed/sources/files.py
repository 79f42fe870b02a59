"""File sources: typed CSV and JSON landings, manifest discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table with exactly the columns of ``schema`` in its header, in any order; malformed rows fail the read.

    Raises ValueError for a repeated, missing or further column.
    """
    header = spark.read.text(path).first()
    names = header[0].split(",") if header else []
    if len(set(names)) < len(names):
        raise ValueError(f"repeated columns in {path}")
    if set(names) != set(schema.names):
        raise ValueError(f"columns of {path} differ from the schema: {sorted(set(names) ^ set(schema.names))}")
    ordered = T.StructType([schema[n] for n in names])
    return spark.read.csv(path, schema=ordered, header=True, mode="FAILFAST", enforceSchema=False).select(*schema.names)


def read_responses(spark: SparkSession, path: str, item: T.StructType, field: str) -> DataFrame:
    """Rows of landed service responses ``{"data": {field: [...]}, "errors": [{"message": ...}]}``, one per line.

    Raises ValueError with the messages, joined, where any response carries errors.
    """
    answer = T.StructType([T.StructField("data", T.StructType([T.StructField(field, T.ArrayType(item))])), T.StructField("errors", T.ArrayType(T.StructType([T.StructField("message", T.StringType())])))])
    parsed = spark.read.text(path).select(F.from_json("value", answer).alias("r"))
    failed = parsed.where(F.size("r.errors") > 0).select(F.array_join("r.errors.message", "; ").alias("m")).limit(20).collect()
    if failed:
        raise ValueError("; ".join(r.m for r in failed))
    return parsed.select(F.explode(f"r.data.{field}").alias("x")).select("x.*")


def exact_raw(amount: str, decimals: str):
    """A decimal text moved by its token's decimals to a whole number as text; null where digits would be lost."""
    text = F.btrim(F.col(amount))
    sign, bare = F.when(text.startswith("-"), "-").otherwise(""), F.regexp_replace(text, "^[-+]", "")
    whole, part = F.regexp_extract(bare, r"^([0-9]+)", 1), F.rtrim(F.regexp_extract(bare, r"\.([0-9]*)$", 1), F.lit("0"))
    d = F.col(decimals).cast("int")
    digits = F.regexp_replace(F.concat(whole, F.rpad(part, d, "0")), "^0+(?=.)", "")
    return F.when(bare.rlike(r"^[0-9]+(\.[0-9]*)?$") & (F.length(part) <= d), F.when(digits == "0", digits).otherwise(F.concat(sign, digits)))


def one_manifest(spark: SparkSession, folder: str, ending: str = "_manifest.csv") -> tuple[str, dict[str, str]]:
    """The stem of the only manifest in a folder and the paths of its sibling files by the rest of their names.

    The folder is listed in the file system that its path names, so it may be one that a cluster shares.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = sorted(f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at))
    found = [n for n in names if n.endswith(ending)]
    if len(found) != 1:
        raise ValueError(f"{len(found)} files that end in {ending} in {folder}, not one")
    stem = found[0].removesuffix(ending)
    return stem, {n[len(stem) + 1 : -4]: f"{folder}/{n}" for n in names if n.startswith(f"{stem}_") and n.endswith(".csv")}
