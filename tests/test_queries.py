"""Each query beside its SQL on the smallest tables, where those are there."""

import math
import os

import duckdb
import pytest

from gridloom.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tidy(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    q = db.execute(ORACLES[name])
    names = [c[0] for c in q.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(([tidy(v) for v in r] for r in df.select(*names).collect()), key=str)
    assert got == sorted(([tidy(v) for v in r] for r in q.fetchall()), key=str)
