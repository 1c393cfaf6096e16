"""Every registered query against its SQL on the smallest tables; queries without SQL have to give rows."""

import datetime
import decimal

import duckdb
import pytest

from loomframe.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(cols).collect())
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    rel = con.sql(registry.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    assert rows == sorted(tuple(map(plain, r)) for r in rel.select(*(f'"{c}"' for c in cols)).fetchall())


def test_sql_has_its_query():
    assert registry.ORACLE_SQL.keys() <= registry.QUERIES.keys()
