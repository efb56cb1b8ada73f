"""Every registered query of the engine runs and equals its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from lexloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([repr([round(r[i], 7) if isinstance(r[i], float) and math.isfinite(r[i]) else r[i] for i in order]) for r in rows])


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name in catalog.ORACLES:
        r = duck.execute(catalog.ORACLES[name])
        columns = [d[0] for d in r.description]
        assert sorted(columns) == sorted(df.columns)
        assert normal(got, df.columns) == normal(r.fetchall(), columns)
