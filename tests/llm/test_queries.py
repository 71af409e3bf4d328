import re

import duckdb

import __spark_entry__ as entry
from tallyspark.llm import queries


def test_all_operators_are_registered():
    named = {int(m[1]) for k in queries.QUERIES if (m := re.match(r"op(\d+)_", k))}
    assert named == set(range(1, 14)) and "pipeline" in entry.queries()
    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())


def test_columns_of_results_match_their_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as from '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        assert sorted(c[0] for c in con.execute(sql).description) == sorted(queries.QUERIES[name](spark, sf).columns)


def test_broadcast_only_when_small(spark):
    from tallyspark.llm import common

    df = spark.range(10)
    assert "broadcast" in common.small(df, 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in common.small(df, 9)._jdf.queryExecution().logical().toString().lower()


def test_components(spark):
    from tallyspark.llm import common

    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (9, 5), (20, 21), (22, 21), (7, 7), *[(100 + i, 101 + i) for i in range(40)]], "u long, v long")
    out = {r.node: r.component for r in common.components(edges).collect()}
    assert all(out[x] == 3 for x in (4, 5, 9)) and out[21] == out[22] == 20 and all(out[100 + i] == 100 for i in range(1, 41))
