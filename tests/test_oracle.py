"""Every query of the catalogue that has SQL, against that SQL."""

import duckdb
import pytest
from millrace.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Queries without a row here.
EMPTY = {"filter_missing_attribute", "filter_wrong_type", "block_flow", "cogroup_anti"}


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else str(v) if not isinstance(v, (int, str, type(None))) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    cur = db.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == names
    order = [cols.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    assert got == want
    assert got or name in EMPTY
