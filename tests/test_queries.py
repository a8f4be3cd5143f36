"""Every query with SQL gives the rows that DuckDB gives."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from graincart.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    return value.isoformat() if isinstance(value, datetime.datetime) else value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    found = duck.sql(catalog.SQL[name])
    assert sorted(found.columns) == names
    wanted = [tuple(plain(dict(zip(found.columns, r, strict=True))[c]) for c in names) for r in found.fetchall()]
    assert ordered([tuple(plain(r[c]) for c in names) for r in df.collect()]) == ordered(wanted)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
