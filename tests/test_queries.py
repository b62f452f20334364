"""Every registered query of the analytics engine against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from alphaloom.plans import registered

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = registered()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    q = QUERIES[name]
    df = q.run(spark, sf)
    assert df.columns == [*q.keys, *q.values]
    rows = [tuple(plain(v) for v in r) for r in df.collect()]
    if q.text is None:
        assert rows
        return
    expected = [tuple(plain(v) for v in r) for r in duck.execute(q.text).fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r[: len(q.keys)])
    assert len(rows) == len(expected)
    for a, b in zip(sorted(rows, key=key), sorted(expected, key=key)):
        assert a[: len(q.keys)] == b[: len(q.keys)]
        for x, y in zip(a[len(q.keys) :], b[len(q.keys) :]):
            assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-6, abs_tol=2 * 10**-q.digits)), (name, a, b)
