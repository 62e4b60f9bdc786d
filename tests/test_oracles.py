"""Every query of the engine against its SQL in DuckDB, over the smallest tables."""

import datetime
import glob
import math
import os
from collections import Counter

import pytest

from chronofold.plans import registry
from cases import DATA

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SLOW = {"bls"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SLOW))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    sql = registry.oracles().get(name)
    if sql is None:
        return
    res = db.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(registry.oracles()) <= set(registry.queries())
