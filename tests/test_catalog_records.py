"""The queries of catalog_records against DuckDB on the smallest given tables."""

import os

import pytest

from prosodia import catalog, catalog_records

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(k for k, f in catalog.QUERIES.items() if f.__module__ == catalog_records.__name__)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        path = f"{FOLDER}/{f}" + ("/*.parquet" if os.path.isdir(f"{FOLDER}/{f}") else "")
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{path}'")
    return c


def rows(names, found):
    cell = lambda x: "null" if x is None or x != x else repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([cell(r[i]) for i in order] for r in found)


@pytest.mark.parametrize("name", NAMES)
def test_query_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    want = duck.execute(catalog.SQL[name])
    assert rows(df.columns, df.collect()) == rows([x[0] for x in want.description], want.fetchall())
