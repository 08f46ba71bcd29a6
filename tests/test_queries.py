"""Every registered query of the engine against its SQL on the same tables."""

import math

import duckdb
import pytest

from placewright.queries import ORACLE_SQL, QUERIES

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v + 0.0, 4)
    if isinstance(v, bool) or v is None:
        return v
    return float(v) if isinstance(v, int) or type(v).__name__ == "Decimal" else v


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    got, want = rows_of(df.collect(), df.columns), rows_of(cur.fetchall(), names)
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_strokes_without_a_value_come_last(spark, con, tmp_path):
    values = [(1, None), (1, 5.0), (1, 1.0), (1, None), (1, math.inf), (2, None), (2, None), (3, 4.0), (None, 9.0), (None, None)]
    spark.createDataFrame(values, "user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    df = QUERIES["dash_runs"](spark, str(tmp_path))
    want = duckdb.connect()
    want.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    cur = want.execute(ORACLE_SQL["dash_runs"])
    names = [d[0] for d in cur.description]
    assert rows_of(df.collect(), df.columns) == rows_of(cur.fetchall(), names)
