import duckdb
import pytest

import __spark_entry__ as entry
from scriptorium.plans import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return str(v) if not isinstance(v, (int, type(None))) else v


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert rows
    if name in queries.ORACLE_SQL:
        cur = duck.execute(queries.ORACLE_SQL[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == columns
        want = [tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()]
        assert sorted(rows, key=str) == sorted(want, key=str)


def test_entry(spark):
    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())
