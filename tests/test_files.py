import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverbed.sources.files import one_manifest, read_csv, read_responses
from riverbed.sources.sinks import append_window, insert_ignore, upsert, write_csv, write_json
from riverbed.streaming.ingest import pattern, run_once, single_events

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    df = spark.createDataFrame([(2, "x,y"), (1, 'q"'), (3, None)], SCHEMA)
    write_csv(df, path, ["a"])
    assert [r.a for r in read_csv(spark, path, SCHEMA).collect()] == [1, 2, 3]
    assert not list(tmp_path.glob("*.part*"))
    for bad in ("a,a\n1,2\n", "a\n1\n", "a,b,c\n1,2,3\n"):
        (tmp_path / "bad.csv").write_text(bad)
        with pytest.raises(ValueError):
            read_csv(spark, str(tmp_path / "bad.csv"), SCHEMA)
    (tmp_path / "bad.csv").write_text("a,b\n1,x,9\nz,y\n")
    with pytest.raises(Exception):
        read_csv(spark, str(tmp_path / "bad.csv"), SCHEMA).collect()


def test_responses(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"data": {"mints": [{"a": 1, "b": "x"}]}}\n{"data": {"mints": []}}\n')
    assert [tuple(r) for r in read_responses(spark, str(tmp_path / "r.json"), SCHEMA, "mints").collect()] == [(1, "x")]
    (tmp_path / "e.json").write_text('{"errors": [{"message": "one"}, {"message": "two"}]}\n')
    with pytest.raises(ValueError, match="one; two"):
        read_responses(spark, str(tmp_path / "e.json"), SCHEMA, "mints")


def test_manifest(spark, tmp_path):
    for n in ("run_manifest.csv", "run_pairs.csv"):
        (tmp_path / n).write_text("")
    stem, files = one_manifest(spark, str(tmp_path))
    assert stem == "run" and set(files) == {"manifest", "pairs"}
    (tmp_path / "other_manifest.csv").write_text("")
    with pytest.raises(ValueError):
        one_manifest(spark, str(tmp_path))


def test_windows_join_and_repeat(spark, tmp_path):
    path, df = str(tmp_path / "w"), spark.createDataFrame([(5,), (9,)], "block_number long")
    append_window(df, path, 0, 9)
    append_window(df, path, 0, 9)
    append_window(spark.createDataFrame([(10,)], "block_number long"), path, 10, 19)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError):
        append_window(df.where("false"), path, 30, 39)
    with pytest.raises(ValueError):
        append_window(df, path, 20, 29)


def test_insert_and_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "old"), (1, "again"), (2, "x")], SCHEMA)
    assert insert_ignore(df, path, ["a"]) == 2 and insert_ignore(df, path, ["a"]) == 0
    upsert(spark.createDataFrame([(1, "zz"), (3, "new")], SCHEMA), path, ["a"], [F.desc("b")], str(tmp_path / "u"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "u")).collect()} == {(1, "zz"), (2, "x"), (3, "new")}
    write_json(spark, {"b": 1}, str(tmp_path / "c.json"))
    assert (tmp_path / "c.json").read_text().startswith("{")


def test_stream_drops_copies_and_bears_repetition(spark, tmp_path):
    src, out = str(tmp_path / "in.parquet"), str(tmp_path / "out")
    df = spark.createDataFrame([(i % 4, f"2021-01-01 00:0{i % 4}:00") for i in range(12)], "i int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    df.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(pattern(src))
    sink = lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")
    for _ in range(2):
        run_once(single_events(stream, "t", ["i"]), str(tmp_path / "state"), sink, "append")
    assert sorted(r.i for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3]
