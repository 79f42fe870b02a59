"""Every query of the core runs on the smallest tables and equals its SQL."""

import glob
import os

import duckdb
import pytest

from compare import plain
from riverbed.plans import ALL

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(n for m in ALL for n in m.QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    module = next(m for m in ALL if name in m.QUERIES)
    df = module.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in module.ORACLE:
        con.execute(module.ORACLE[name])
        names = [d[0] for d in con.description]
        assert sorted(names) == columns
        assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in con.fetchall()), key=repr)
    else:
        assert got


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(NAMES) <= set(e.queries())
