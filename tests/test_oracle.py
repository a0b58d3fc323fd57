"""Every registered query against its DuckDB oracle on the smallest tables
(the driver repeats this at sf 0.01)."""

import math

import duckdb
import pytest

import catalog
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    r = con.execute(catalog.ORACLE[name])
    ocols = [d[0] for d in r.description]
    exp = r.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, got) == _rows(ocols, exp)


def test_every_query_has_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
