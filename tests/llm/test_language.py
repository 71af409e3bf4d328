import zlib

import numpy as np

from tallyspark.llm import language


def test_held_out_accuracy(spark, sf):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = language.op9(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    own = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]
    print(len(own), sum(own) / len(own))
    assert sum(own) / len(own) > 0.95


def test_gradients_are_right():
    net = language.Network(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(5)
    code, y = r.integers(97, 105, (7, 5)).astype(np.uint8), r.integers(0, 3, (7, 5))
    _, g = net.slopes(code, y)
    for k in net.p:
        for _ in range(4):
            at = tuple(r.integers(0, n) for n in net.p[k].shape)
            at = (code[0, 0], *at[1:]) if k == "bytes" else at
            was, e = net.p[k][at], 1e-4
            net.p[k][at] = was + e
            up = net.slopes(code, y)[0]
            net.p[k][at] = was - e
            down = net.slopes(code, y)[0]
            net.p[k][at] = was
            assert abs((up - down) / (2 * e) - g[k][at]) < 1e-5, k


def by_hand(net, text):
    """Mean label probabilities of a text's bytes, window by window and byte by byte."""
    code = bytes(c + 32 if 65 <= c < 91 else c for c in text.encode())
    H = language.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    total = np.zeros(len(net.langs))
    for s in range(0, len(code), language.WINDOW):
        e = min(s + language.WINDOW, len(code))
        a, z = max(0, s - language.AROUND), min(len(code), e + language.AROUND)
        states = {}
        for d, places in (("f", range(a, z)), ("b", range(z - 1, a - 1, -1))):
            h = np.zeros(H)
            for i in places:
                x = p["bytes"][code[i]] @ p[f"x{d}"] + p[f"b{d}"]
                u = sig(x[: 2 * H] + h @ p[f"h{d}"])
                c = np.tanh(x[2 * H :] + (u[H:] * h) @ p[f"c{d}"])
                h = h + u[:H] * (c - h)
                states[d, i] = h
        for i in range(s, e):
            q = np.exp(np.concatenate([states["f", i], states["b", i]]) @ p["out"] + p["out_b"])
            total += q / q.sum()
    return total / max(total.sum(), 1e-9)


def test_edges_and_pooling_by_hand(spark):
    net = language.train([(b"der und nicht ", 0), (b"the and not ", 1)], ["de", "en"], 60)
    texts = [None, "", "12 34!", "§ €", "é", "THE and not", "der nicht und", "the " * 50_000, "d" * 100_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[5], "x"), (5, texts[5], "x")], "doc_id long, text string, score string")
    out = language.label(docs, net).collect()
    assert len(out) == len(texts) + 2
    want = ["und"] * 4 + [None, "en", "de", "en", None]
    for r in out:
        i = 5 if r.doc_id is None else r.doc_id
        assert r.lang_pred == (want[i] or r.lang_pred) and (r.score == 0) == (i < 4)
    r = np.random.default_rng(3)
    more = ["".join(r.choice(list("abcdé .1Z"), n)) for n in (1, 7, 111, 112, 113, 120, 300, 1000, 3000)] + ["", "the der " * 30]
    data = np.frombuffer("".join(more).encode(), np.uint8)
    got = language.Labeller(net).pooled(data, np.cumsum([0, *(len(t.encode()) for t in more)]))
    for t, g in zip(more, got):
        assert np.allclose(g, by_hand(net, t), atol=1e-4), t
    nothing = language.fit(docs.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r.lang_pred for r in language.label(docs, nothing).collect()} == {"und"}
    assert language.label(docs.limit(0), net).count() == 0


def test_few_ids_of_many_rows_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "DOCS", 10)
    able = spark.range(1000).withColumnRenamed("id", "doc_id").filter(~language.common.held_out(language.F.col("doc_id"), language.PARTS, language.PART))
    late = able.filter("(xxhash64(doc_id) & ((1 << 30) - 1)) / (1 << 30) > 0.7").limit(3)
    docs = late.selectExpr("doc_id", "'some words here' as text", "'xx' as lang", "explode(sequence(1, 100)) as n")
    assert docs.count() == 300
    assert language.fit(docs, 1).langs == ["xx"]
