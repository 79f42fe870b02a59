import pytest
from pyspark.sql import functions as F

from riverbed.functions.bigint import limbs_needed, sum_limbs, text_of
from riverbed.functions.exact import exact_cents, finite, too_large
from riverbed.functions.keys import clean_address, clean_key
from riverbed.functions.scalars import block_bin, direction, fnv1a, location, log1p_of, outside, ratio, seeded_score, slug, spacing_of
from riverbed.sources.files import exact_raw


def one(spark, schema, rows, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_addresses_and_keys(spark):
    a = "AbCdEf0123456789aBcDeF0123456789abcdef01"
    got = one(spark, "a string", [(a,), ("0X" + a + " ",), ("\t0x" + a.lower() + "\r\n",), ("",), (None,), ("  ",)], clean_address("a"), clean_key("a"))
    assert [g[0] for g in got] == ["0x" + a.lower()] * 3 + [None] * 3
    assert got[1][1] == "0x" + a.lower()


def test_finite_and_cents(spark):
    got = one(spark, "x double", [(float("nan"),), (float("inf"),), (None,), (-0.01,), (9.569494848405074e18,), (1.005,)], finite("x"), exact_cents("x").cast("string"))
    assert [g[1] for g in got[:4]] == [None, None, None, "-1"]
    assert int(got[4][1]) == int(9.569494848405074e18 * 100) and got[5][1] == "100"
    got = one(spark, "x double", [(1e30,), (-5e26,), (9.9e25,), (None,), (float("inf"),)], exact_cents("x").cast("string"), too_large("x"))
    assert got == [(None, True), (None, True), (str(int(9.9e25 * 100)), False), (None, False), (None, False)]


def test_big_sums(spark):
    big = [str(2**250), "-" + str(2**249), "+7", "-1", None, "no number"]
    df = spark.createDataFrame([("a", b) for b in big] + [("b", None)], "k string, x string")
    n = limbs_needed(df, "x")
    sums = df.groupBy("k").agg(*[s.alias(f"l{i}") for i, s in enumerate(sum_limbs(F.col("x"), n))])
    got = {r.k: r.t for r in sums.select("k", text_of([F.col(f"l{i}") for i in range(n)]).alias("t")).collect()}
    assert n == 5 and got == {"a": str(2**250 - 2**249 + 6), "b": None}
    long = spark.createDataFrame([("9" * 100,), ("1",), ("-" + "0" * 120 + "5",)], "x string")
    n = limbs_needed(long, "x")
    assert n == 6 and long.agg(*[s.alias(f"l{i}") for i, s in enumerate(sum_limbs(F.col("x"), n))]).select(text_of([F.col(f"l{i}") for i in range(n)])).first()[0] == str(10**100 - 5)
    assert limbs_needed(long.where("false"), "x") == 1
    with pytest.raises(Exception, match="more digits"):
        long.select(*sum_limbs(F.col("x"), 5)).collect()


def test_scaling_rejects_lost_digits(spark):
    got = one(spark, "a string, d int", [("1.5", 2), ("-0.001", 2), ("-12", 0), ("0.00", 1), ("7.10", 1), ("x", 1), (None, 1)], exact_raw("a", "d"))
    assert [g[0] for g in got] == ["150", None, "-12", "0", "71", None, None]


def test_labels(spark):
    got = one(spark, "t int, l int, u int", [(-150, -100, 100), (-100, -100, 100), (100, -100, 100), (150, -100, 100), (None, 1, 2)], location(F.col("t"), F.col("l"), F.col("u")), outside(F.col("t"), F.col("l"), F.col("u")))
    assert got == [("below_current_tick", 50), ("active", 0), ("above_current_tick", 0), ("above_current_tick", 50), (None, None)]
    got = one(spark, "a int, b int", [(10, -20), (-15, 8), (1, 1), (0, 0), (None, 1)], direction(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == ["zero_for_one", "one_for_zero", None, None, None]
    assert one(spark, "f int", [(100,), (500,), (3000,), (10000,), (7,)], spacing_of(F.col("f"))) == [(1,), (10,), (60,), (200,), (None,)]


def test_guards(spark):
    assert one(spark, "a double, b double", [(1.0, 0.0), (1.0, 4.0), (1.0, -2.0), (1.0, None)], ratio(F.col("a"), F.col("b"), 100)) == [(0.0,), (25.0,), (0.0,), (0.0,)]
    assert [round(g[0], 6) for g in one(spark, "a double", [(-1.0,), (float("nan"),), (1.0,), (None,)], log1p_of(F.col("a")))] == [0.0, 0.0, 0.693147, 0.0]
    assert one(spark, "s string", [(" A--b c!",), ("!!",), (None,)], slug(F.col("s"))) == [("a_b_c",), ("pool",), ("pool",)]
    assert [g[0] for g in one(spark, "b long", [(100,), (101,), (199,)], block_bin(F.col("b"), F.lit(100), F.lit(199), 4))] == [0, 0, 3]


def test_hashes(spark):
    import hashlib

    got = one(spark, "s string", [("key",), (None,)], seeded_score(20260725, F.col("s")), fnv1a(F.col("s")))
    h = 0xCBF29CE484222325
    for b in b"key":
        h = (h ^ b) * 0x100000001B3 % 2**64
    assert got[0] == (hashlib.sha256((20260725).to_bytes(8, "big") + b"key").hexdigest(), h & (2**63 - 1)) and got[1] == (None, None)
