"""Every query has a result, and equals its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(entry.own.QUERIES)

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, name):
    df = entry.own.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    if name not in entry.own.ORACLE_SQL:
        return
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = sorted(c.sql(f"SELECT {', '.join(columns)} FROM ({entry.own.ORACLE_SQL[name]})").fetchall(), key=repr)
    assert len(got) == len(want)
    assert all(close(x, y) for a, b in zip(got, want) for x, y in zip(a, b)), (got[:3], want[:3])


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 15 and sum(r.kept for r in rows) == 12
