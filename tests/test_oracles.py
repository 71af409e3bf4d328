import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallyspark.plans import catalog, collected, filters, more, stateful, status  # noqa: F401


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as from '{sf}/{f}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    cur = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want, got = plain(cur.fetchall(), columns), plain(map(tuple, df.collect()), df.columns)
    assert len(got) > 0 and got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLES) <= set(entry.oracle_sql())
