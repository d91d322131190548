"""Every registered query of the library against its SQL oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

from eligspark.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for name in os.listdir(DATA):
        db.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return db


def rows(raw, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cell = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[k]) for k in order) for r in raw)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLES:
        want = db.sql(ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows(want.fetchall(), want.columns)
