import zlib

import pytest

from tallyspark.llm import toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = toxicity.op3(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    pairs = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    hit = sum(p and y for p, y in pairs)
    precision, recall = hit / sum(p for p, _ in pairs), hit / sum(y for _, y in pairs)
    print("held out", len(pairs), precision, recall)
    assert precision > 0.9 and recall > 0.85


def test_edges_and_worst_sentence(spark):
    texts = [None, "", "...", "good day. é you vile Thing! fine", "good " * 40_000]
    train = spark.createDataFrame([(100 + i, "a good day. nice vile words" if i % 3 == 0 else "a good day. nice words", "s") for i in range(90)], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(100 + i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(train, labels)
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[3]), (3, texts[3])], "doc_id long, text string")
    out = toxicity.score(docs, model).collect()
    assert len(out) == 7
    for r in out:
        if r.doc_id in (3, None):
            assert r.score > 0.5 and texts[3][r.worst_start : r.worst_end] == "é you vile Thing"
        else:
            assert r.score < 0.3 and r.worst_start is None
    assert {r.doc_id for r in toxicity.clean(docs, model).collect()} == {0, 1, 2, 4}
    nothing = toxicity.fit(train.limit(0), labels.limit(0))
    assert max(r.score for r in toxicity.score(docs, nothing).collect()) < 0.01
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_noisy_or_and_its_slopes_by_hand():
    import numpy as np

    r = np.random.default_rng(4)
    y, count = np.array([1, 0, 1, 0]), np.array([3, 2, 0, 4])
    owner = np.repeat(np.arange(4), count)
    bag, at = r.integers(0, 9, 30), r.integers(0, 5, 30)
    share, w, b = np.array([0.1, 0.2, 0.3, 0.4]), r.normal(size=5), -0.4

    def loss(w, b):
        total = 0.0
        for i in range(4):
            clear = 1.0
            for k in np.flatnonzero(owner == i):
                clear *= 1 - 1 / (1 + np.exp(-(b + sum(w[at[j]] for j in range(30) if bag[j] == k))))
            total -= share[i] * (np.log(1 - clear) if y[i] and clear < 1 else np.log(clear) if not y[i] else 0.0)
        return total

    gw, gb = toxicity.noisy_or(y, owner, bag, at, share, w, b)
    for k in range(5):
        e = np.eye(5)[k] * 1e-6
        assert abs((loss(w + e, b) - loss(w - e, b)) / 2e-6 - gw[k]) < 1e-6
    assert abs((loss(w, b + 1e-6) - loss(w, b - 1e-6)) / 2e-6 - gb) < 1e-6


def test_score_equals_brute_force():
    import re

    import numpy as np

    r = np.random.default_rng(5)
    vocabulary = ["alpha", "be", "gammarays", "delta", "épsilon", "ZETA"]
    texts = [" ".join(r.choice([*vocabulary, ".", "!", "\n"], 40)) for _ in range(20)] + ["", "..."]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    one = np.frombuffer(" ".join(vocabulary).encode(), np.uint8)
    h = toxicity.features(one, np.array([0, len(one)]))[2]
    weights = {}
    for k, n in enumerate(toxicity.PREFIXES):
        for j, w in enumerate(vocabulary):
            if h[k, j]:
                weights.setdefault(int(h[k, j]), (k, w.lower().encode()[: n or None], float(r.normal())))
    keys = np.array(list(weights), np.uint64)
    model = toxicity.Model(keys, np.array([v[2] for v in weights.values()]), -1.0)
    by = {v[:2]: v[2] for v in weights.values()}
    got = model.score(data, at)[0]
    for i, t in enumerate(texts):
        clear = 1.0
        for sentence in re.split(r"[.!?\n]", t):
            words = [w.lower().encode() for w in sentence.split()]
            if words:
                has = {(k, w[: n or None]) for w in words for k, n in enumerate(toxicity.PREFIXES) if len(w) >= max(1, n)}
                clear *= 1 - 1 / (1 + np.exp(1.0 - sum(by.get(x, 0.0) for x in has)))
        assert abs(got[i] - (1 - clear)) < 1e-9


def test_sample_is_bounded_in_characters(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LONGEST", 60)
    rows = [(i, ("a vile word here" if i % 3 == 0 else "a nice word here") + (" and more" * 50 if i >= 60 else "")) for i in range(90)]
    docs = spark.createDataFrame(rows + [(0, "zz vile")] * 5, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = {r.doc_id: r.score for r in toxicity.score(docs.filter("doc_id > 0"), model).collect()}
    assert all((out[i] > 0.5) == (i % 3 == 0) for i in range(1, 90))
    monkeypatch.setattr(toxicity, "CHARS", 0)
    assert len(toxicity.fit(docs, labels).keys) == 0
