"""Every query of the core with SQL gives the rows that DuckDB gives; the others run and have rows."""

import math
import os

import duckdb
import pytest

from lodestack.plans.catalogue import QUERIES, SQL


def rows(raw):
    def value(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6)
        return int(x) if isinstance(x, bool) else x

    return sorted((tuple(map(value, r)) for r in raw), key=repr)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(data):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    if name not in SQL:
        return
    found = duck.execute(SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert rows(got) == rows(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())
