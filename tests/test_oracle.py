"""The driver contract: every key with SQL matches DuckDB on the smallest tables."""
import math
from datetime import date, datetime

import duckdb
import pytest

import __spark_entry__ as E

from conftest import SF001

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (date, datetime)):
        return v.isoformat()
    return v


def _key(r):
    return tuple((x is None, str(x)) for x in r)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_contract_shape(spark):
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 60
    assert E.entry(spark).count() > 0


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_key_matches_duckdb(spark, con, key):
    df = E.queries()[key](spark, SF001)
    cols = df.columns
    rows = sorted([tuple(_norm(x) for x in r) for r in df.collect()], key=_key)
    cur = con.execute(E.oracle_sql()[key])
    ocols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(ocols)
    idx = [ocols.index(c) for c in cols]
    orows = sorted([tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()], key=_key)
    assert rows == orows
