"""Filters, look-ups by prefix and revisions, worked out by hand."""

from tallyspark.operators import dedup
from tallyspark.plans import filters


def test_filters_leave_what_is_not_chosen(spark):
    facts = spark.createDataFrame([("a", "p", "m", 1), ("b", "p", "m", 2), ("a", "q", "m", 3), ("a", None, "m", 4)], "agent string, provider string, model string, n int")
    one = spark.createDataFrame([("a",), ("a",)], "agent string")
    pair = spark.createDataFrame([("p", "m"), (None, "m")], "provider string, model string")
    told = lambda *x: sorted(r.n for r in filters.filtered(facts, *x).collect())
    assert (told(), told(one), told(None, pair), told(one, pair), told(one.limit(0))) == ([1, 2, 3, 4], [1, 3, 4], [1, 2], [1], [])


def test_latest_state_by_prefix(spark):
    state = spark.createDataFrame([("k:s:1:aa", 5), ("k:s:1:bb", 7), ("k:s:1:ab", 7), ("k:s:10:zz", 9), ("k:s:2:cc", 1), ("none", 3)], "key string, observed_ms long")
    wanted = spark.createDataFrame([("k:s:1:",), ("k:s:2:",), ("k:s:3:",), ("k:s:",)], "prefix string")
    assert sorted(map(tuple, filters.latest_by_prefix(state, wanted).collect())) == [("k:s:1:", "bb", 7), ("k:s:2:", "cc", 1)]


def test_chosen_revision(spark):
    rows = [
        ("a", 5, 1, "s1", 3, "f", True, 10, 1), ("a", 9, 2, "s2", 1, "g", True, 12, None), ("a", 9, 1, "s3", 1, "f", True, 11, 1), ("a", 99, 1, "s4", 9, "f", False, 50, 1),
        ("b", None, 1, "s1", 1, "f", False, 1, None), ("b", None, 2, "s2", 1, "f", False, 2, None), ("c", 1, 1, "s", 1, "f", True, 4, None), ("c", 2, 1, "s", 1, "f", True, 4, None),
    ]
    df = spark.createDataFrame(rows, "key string, at_ms long, line int, session string, file_ms long, path string, complete boolean, total long, output long")
    out = {r.key: tuple(r)[1:] for r in dedup.chosen_revision(df, "key", "at_ms", ("line",), ("file_ms", "path", "line"), "complete", ("total", "output")).collect()}
    assert out == {"a": (12, None, True, "s3", 5, True), "b": (2, None, False, "s1", None, False), "c": (4, None, True, "s", 1, False)}
