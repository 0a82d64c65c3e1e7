"""Every registered query against its SQL in another engine, on the smallest tables; those without SQL must give rows."""

import datetime
import decimal
import math
from collections import Counter

import duckdb
import pytest

from gridloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return None if math.isnan(v) else float(f"{float(v):.8g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_gives_rows(spark, name):
    """Queries beyond SQL give rows, and numbers that are finite."""
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    numbers = [v for r in rows for v in r if isinstance(v, float)]
    assert all(math.isfinite(v) for v in numbers)
