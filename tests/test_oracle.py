"""Every query with SQL against DuckDB over the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tickloom import plans

SQL, QUERIES = plans.oracle_sql(), plans.queries()


def plain(v):
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    got = df.collect()
    assert name in SQL, "a query of this part without SQL"
    r = duck.execute(SQL[name])
    columns = sorted(c[0] for c in r.description)
    assert sorted(df.columns) == columns
    at = [[c[0] for c in r.description].index(c) for c in columns]
    want = sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=str)
    assert sorted((tuple(plain(row[c]) for c in columns) for row in got), key=str) == want
