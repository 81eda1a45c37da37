"""Every query with SQL against DuckDB on the smallest tables; every other one runs and keeps its columns."""

import duckdb
import pytest

from coppice import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(r[i], 9)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_equals_sql(spark, db, name):
    got = q.QUERIES[name](spark, SF)
    want = db.execute(q.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_runs(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 0
