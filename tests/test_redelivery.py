import random
from datetime import datetime, timedelta

import pytest

from riverbed.operators.components import connected_components
from riverbed.operators.redelivery import batch_pairs, kept_deliveries, repeated_deliveries, single_actions, single_deliveries, streamed_repeats, without_repeats

SCHEMA = "delivery_id long, id string, block_number long, log_index int, block_timestamp timestamp, extra string"


def feed(seed, n=300):
    rng, rows = random.Random(seed), []
    for d in range(1, n + 1):
        a = rng.randrange(n // 3)
        name = rng.choice([f"Mint:{a}", f" mint:{a}\t", f"MINT:{a + rng.randrange(2)}", None, "", "hot"] if rng.random() < 0.3 else [f"mint:{a}"])
        place = (a + (rng.random() < 0.1), 1) if rng.random() < 0.9 else (None, 1)
        rows.append((d, name, place[0], place[1], datetime(2021, 1, 1) + timedelta(hours=7 * (d * 3 // n)), "x"))
    rows.append((None, "mint:1", 1, 1, None, "no number"))
    rows.append(rows[5])
    return rows


def brute(rows):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    numbered = [r for r in rows if r[0] is not None]
    for d, name, b, log, *_ in numbered:
        root(("d", d))
        key = (name or "").strip(" \t\r\n").lower()
        if key:
            parent[root(("d", d))] = root(("i", key))
        if b is not None and log is not None:
            parent[root(("d", d))] = root(("p", b, log))
    first = {}
    for d, *_ in numbered:
        r = root(("d", d))
        first[r] = min(first.get(r, d), d)
    return set(first.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_kept_equals_union_find(spark, seed):
    rows = feed(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    kept = kept_deliveries(batch_pairs(df))
    want = brute(rows)
    assert {r.delivery for r in kept.collect()} == want
    repeated = [r.delivery_id for r in repeated_deliveries(df, kept).collect()]
    assert sorted(repeated) == sorted({r[0] for r in rows if r[0] is not None} - want)
    single = single_deliveries(df, kept).collect()
    assert {r.delivery_id for r in single} == want and len(single) == len(want) and "extra" in single[0]


def timed_feed(seed, n=400):
    """Actions with a time of their own; their copies come at once, in a later file, or much later."""
    rng, rows = random.Random(seed), []
    for d in range(1, n + 1):
        a = rng.randrange(n // 2) if rng.random() < 0.3 else d // 2
        t = datetime(2021, 1, 1) + timedelta(days=a // 8) if a % 29 else None
        name = rng.choice([f"mint:{a}", f" MINT:{a} ", f"mint:{a}b", None, ""])
        rows.append((d, name, a if rng.random() < 0.9 else None, 1, t, "x"))
    return rows


@pytest.mark.parametrize("delay, shuffled", [("1 second", False), ("3 days", True)])
def test_runs_of_a_stream_equal_the_batch(spark, tmp_path, delay, shuffled):
    rows = timed_feed(4) + [(None, "mint:1", 1, 1, None, "no number")]
    if shuffled:
        random.Random(9).shuffle(rows)
    path, registry, checkpoint = (str(tmp_path / x) for x in ("feed.parquet", "registry", "seen"))
    parts, had = [rows[i * 45 : i * 45 + 45] for i in range(9)], []
    for run in range(3):
        for part in parts[run * 3 : run * 3 + 3]:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
            had += part
        got = [r.delivery for r in streamed_repeats(spark, path, registry=registry, checkpoint=checkpoint, files=1, delay=delay, buckets=3).collect()]
        assert sorted(got) == sorted({r[0] for r in had if r[0] is not None} - brute(had)), run
    feed = spark.read.parquet(path)
    kept = [r.delivery_id for r in without_repeats(feed, spark.createDataFrame([(d,) for d in got], "delivery long")).collect()]
    assert sorted(kept) == sorted(brute(rows))
    batches = {r.batch for r in spark.read.parquet(registry).select("batch").distinct().collect()}
    assert max(batches) == 8 and spark.read.parquet(registry).where("what = 2").count() > 0


def test_a_hot_identifier_reaches_the_state_once_a_task(spark, tmp_path):
    path, registry = str(tmp_path / "feed.parquet"), str(tmp_path / "registry")
    rows = [(d, "same", d, 0, datetime(2021, 1, 1), "") for d in range(1, 3000)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    assert sorted(r.delivery for r in streamed_repeats(spark, path, registry=registry).collect()) == list(range(2, 3000))


@pytest.mark.parametrize("seed", [1, 2])
def test_single_actions(spark, seed):
    rows = feed(seed)
    got = single_actions(spark.createDataFrame(rows, SCHEMA), ["delivery_id", "extra"]).collect()
    assert sorted(r.delivery_id for r in got) == sorted(brute(rows)) and set(got[0].asDict()) == {"delivery_id", "extra"}
    assert sorted(got) == sorted(single_actions(spark.createDataFrame(rows, SCHEMA), ["delivery_id", "extra"], narrow=True).collect())


def test_stream_of_nothing(spark, tmp_path):
    path = str(tmp_path / "feed.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert streamed_repeats(spark, path).count() == 0


def test_empty_feed(spark):
    df = spark.createDataFrame([], SCHEMA)
    kept = kept_deliveries(batch_pairs(df))
    assert kept.count() == 0 and repeated_deliveries(df, kept).count() == 0


def test_hot_identifier_is_one_action(spark):
    df = spark.createDataFrame([(d, "same", d, 0, None, "") for d in range(1, 2000)], SCHEMA)
    assert [r.delivery for r in kept_deliveries(batch_pairs(df)).collect()] == [1]


def test_long_chain_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 500), (600, 601), (601, 600), (None, 3)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 600: 600, 601: 600}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
