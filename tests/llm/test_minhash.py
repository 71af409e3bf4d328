import random

import pytest

from tallyspark.llm import minhash


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows, percent=85):
    sets = {d: shingles(t) for d, t in rows}
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    for d, s in sets.items():
        for e in {e for x in s for e in by[x]}:
            if e > d and 100 * len(s & sets[e]) >= percent * len(s | sets[e]):
                a, b = sorted((root(d), root(e)))
                label[b] = a
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_whole_table_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(minhash.op7(spark, sf)) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A\tB"), (6, "a b c d e"), (7, "a b c d e"), (8, "x " * 3000), (9, "x " * 4000), (10, "é è"), (None, "a b")]
    out = minhash.near_duplicates(spark.createDataFrame([(d, t, 0, "q") for d, t in rows], "doc_id long, text string, n int, key string"), 85).collect()
    assert len(out) == len(rows)
    want = brute([r for r in rows if r[0] is not None])
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out if r.doc_id is not None} == want
    assert next(r for r in out if r.doc_id is None).kept
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_bucket_of_near_copies_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 5)
    r = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(260):
        words = list(base)
        for _ in range(r.randint(0, 9)):
            words[r.randrange(150)] = f"e{r.randrange(40)}"
        rows.append((d, " ".join(words)))
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85)) == brute(rows)
    monkeypatch.setattr(minhash.common, "HOT", 3)
    monkeypatch.setattr(minhash, "MANY", 6)  # hubs within shared differences
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80)) == brute(rows, 80)
    monkeypatch.setattr(minhash, "MANY", 1 << 14)
    monkeypatch.setattr(minhash.common, "HOT_KEYS", 0)  # all joins salted
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85)) == brute(rows)


def test_id_with_several_texts_links_them(spark):
    w, v = (" ".join(f"{c}{i}" for i in range(60)) for c in "wv")
    rows = [(1, w), (1, v), (1, v), (2, w), (3, v + " end"), (5, "other words of some text here"), (4, v.upper())]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert len(out) == len(rows) and {(r.doc_id, r.component_id) for r in out} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)}
    assert sorted(r.n_shingles for r in out) == [2, 56, 56, 56, 56, 56, 57]
