"""Every query against its SQL, on the smallest tables."""

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb
import pytest

from postloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int | float | decimal.Decimal):
        return float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v if isinstance(v, str) else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(_plain(r[k]) for k in order) for r in values)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_gives_what_its_sql_gives(spark, oracle, name):
    found = catalog.QUERIES[name](spark, SF)
    got = rows(found.columns, found.collect())
    if name in catalog.SQL:
        result = oracle.execute(catalog.SQL[name])
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(found.columns)
        assert got == rows(columns, result.fetchall())


def test_every_sql_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
