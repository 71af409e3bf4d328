import hashlib
import random

import duckdb

from tallyspark.llm import decontaminate


def brute(rows, items, window=10):
    wins = {}
    for name, text in items:
        w = decontaminate.words_of(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add(name)
    sizes = {len(w) for w in wins}
    out = []
    for doc, text in rows:
        w = decontaminate.words_of(text)
        hit, names = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (got := wins.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    names |= {str(x) for x in got if x is not None}
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_against_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as from '{sf}/{t}.parquet'")
    assert sorted(con.execute(decontaminate.SQL).fetchall()) == sorted(tuple(r) for r in decontaminate.op10(spark, sf).collect())


def test_random_small_alphabet(spark, monkeypatch):
    r = random.Random(1)
    text = lambda n, k: " ".join(r.choice("abcdefg"[:k]) for _ in range(n))
    items = [(i, text(r.randint(0, 25), 4)) for i in range(12)] + [(3, "g"), (None, "f f"), (99, None), (98, "é É a")]
    rows = [(i, text(r.randint(0, 120), 7)) for i in range(60)] + [(7, None), (None, "É é b é É a"), (8, "G," * 5000)]
    rows += [(100 + i, f"x {t} y-{t.upper()}") for i, (_, t) in enumerate(items) if t]
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for window in (10, 3):
        assert sorted((tuple(x) for x in decontaminate.contamination(docs, bench, window).collect()), key=str) == brute(rows, items, window)
    monkeypatch.setattr(decontaminate, "MOST_WORDS", 24)
    assert sorted((tuple(x) for x in decontaminate.contamination(docs, bench, 10).collect()), key=str) == brute(rows, items, 10)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, bench).count() == 0
    assert [tuple(x)[1:4] for x in decontaminate.contamination(spark.createDataFrame([(1, "a b")], docs.schema), bench).collect()] == [(2, 0, 0)]


def test_remove(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"Clean start. {item}! And " + "more " * 20, 5), (2, item, 6), (3, "all é clean\n", 7), (4, None, None)], "doc_id long, text string, k int")
    out = {x.doc_id: (x.text, x.k) for x in decontaminate.remove(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert out == {1: ("Clean start. ! And " + "more " * 20, 5), 3: ("all é clean\n", 7), 4: (None, None)}


def test_remove_keeps_columns_of_any_name(spark):
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a one two three b c d e f", 5, "x", None), (2, None, 6, "y", 1)], "doc_id long, text string, _hits int, `_Items` string, _hits_ long")
    out = {r.doc_id: tuple(r)[1:] for r in decontaminate.remove(docs, items).collect()}
    assert out == {1: ("a  b c d e f", 5, "x", None), 2: (None, 6, "y", 1)}
    assert decontaminate.remove(docs, items).columns == docs.columns


def test_remove_cuts_short_items(spark):
    items = spark.createDataFrame([(1, "One two three four five six seven"), (2, "eight nine")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Before, one two three FOUR five six seven! " + "more " * 20), (2, "eight nine " + "more " * 20), (3, "one two three " * 9)], "doc_id long, text string")
    out = decontaminate.remove(docs, items)
    assert {r.doc_id: r.text for r in out.collect()} == {1: "Before, ! " + "more " * 20, 2: " " + "more " * 20, 3: "one two three " * 9}
    assert decontaminate.contamination(out, items).filter("contaminated").count() == 0


def test_one_python_worker_a_task(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d x " * 9), (2, "e f"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d"), (2, "e f")], "item_id long, text string")
    for most in (decontaminate.MOST_WORDS, 4):  # one automaton; one each
        monkeypatch.setattr(decontaminate, "MOST_WORDS", most)
        for out, rows in ((decontaminate.contamination(docs, bench), 3), (decontaminate.remove(docs, bench), 1)):
            assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
            assert out.count() == rows
