"""Every registered core query against its SQL twin in DuckDB."""

import os

import duckdb
import pytest

from quillon import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return None if v is None else str(int(v)) if not isinstance(v, str | bool) and hasattr(v, "as_integer_ratio") else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted([tuple(map(plain, (r[c] for c in cols))) for r in df.collect()], key=str)
    cur = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted([tuple(map(plain, (r[names.index(c)] for c in cols))) for r in cur.fetchall()], key=str)
    assert got == want
