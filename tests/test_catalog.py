"""Every registered query against its SQL on the smallest tables; those without SQL must run and give rows."""

import math
import os

import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def catalog():
    from siltstone.plans import catalog

    return catalog


def plain(v):
    import datetime
    import decimal

    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog().QUERIES))
def test_query(spark, sf, duck, name):
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    df = catalog().QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    if name not in catalog().ORACLE_SQL:
        assert got
        return
    r = duck.execute(catalog().ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr(tuple(plain(x[i]) for i in at)) for x in r.fetchall())
