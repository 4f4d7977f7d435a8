"""Every query with SQL gives the rows that DuckDB gives, at the smallest scale."""

import math

import duckdb
import pytest

from veriloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "null" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(float(v)) if isinstance(v, int) and not isinstance(v, bool) else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    cursor = db.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()) == want
