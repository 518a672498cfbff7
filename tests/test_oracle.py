"""Every query of the catalog against DuckDB's SQL over the same tables."""

import glob
import math
import os

import duckdb
import pytest

from sievework.plans import catalog

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, int) and not isinstance(x, bool):
        return int(x)
    return x


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_names():
    assert set(catalog.SQL) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    cur = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(got.columns)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(columns, cur.fetchall())
