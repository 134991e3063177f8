"""Every query with a SQL twin returns the same rows as DuckDB."""

import math

import duckdb
import pytest

from cadenza.plans import catalogue, chain, voices

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("events", "embeddings", "customer", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) < 2e-5


QUERIES, ORACLES = catalogue.QUERIES | voices.QUERIES | chain.QUERIES, catalogue.ORACLES | voices.ORACLES | chain.ORACLES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    assert got
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        columns = [c[0] for c in found.description]
        want = rows_of(columns, found.fetchall())
        assert sorted(columns) == sorted(df.columns)
        assert len(got) == len(want)
        assert all(close(x, y) for g, w in zip(got, want) for x, y in zip(g, w))
