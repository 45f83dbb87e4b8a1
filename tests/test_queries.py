"""Every query runs at the smallest scale and equals its SQL there."""

import duckdb
import pytest

from ridgeline import queries as q

from conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW_SQL = {"e2_regional_maxima_3d"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, duck, name):
    df = q.queries()[name](spark, f"{DATA}/sf0.001")
    columns = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    sql = q.oracle_sql().get(name)
    if sql is None or name in SLOW_SQL:
        return
    rel = duck.sql(sql)
    at = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    assert rows == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
