from tallyspark.llm import quality


def test_held_out_accuracy(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = quality.op8(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    pairs = [(r.kept, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    accuracy = sum(k == bool(y) for k, y in pairs) / len(pairs)
    print(len(pairs), accuracy)
    assert accuracy > 0.93 and all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, "en"), (2, "", "s", None), (3, "word " * 50_000, "s", "en"), (3, "word " * 3, "s", "en"), (None, "fine words stand here", "s", "en")], "doc_id long, text string, source string, lang string").selectExpr("*", "1 as score", "'z' as host")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (none, spark.createDataFrame([(1, 0, 0), (3, 1, 0), (2, None, 1), (None, 1, 1)], none.schema)):
        out = quality.classify(docs, labels).collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 and r.kept is not None for r in out)
    assert quality.classify(docs.limit(0), none).count() == 0


def test_sparse_sites_shrink(spark):
    groups = spark.createDataFrame([("big", 1000, 100.0, 0.8), ("small", 1, 0.0, 0.8), ("mid", 200, 170.0, 0.8)], "h string, n long, s double, top double")
    rate = {r.h: r.rate for r in quality._shrunk(groups, "top").collect()}
    assert abs(rate["big"] - 0.1) < 0.02 and 0.1 < rate["small"] < 0.8 and abs(rate["mid"] - 0.85) < 0.01


def test_posteriors_by_hand(spark, sf):
    """Host and path rates and scores of a whole table, from its labels, in numpy."""
    import zlib

    import numpy as np

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    of = {r.doc_id: (r.source, r.lang) for r in docs.collect()}
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % quality.PARTS != quality.PART}

    def shrunk(groups, prior):
        n, s = (np.array([g[i] for g in groups.values()], float) for i in (0, 1))
        p = np.array([prior[k] for k in groups])
        on = n > 0
        seen, noise, most = (n[on] * (s[on] / n[on] - p[on]) ** 2).sum(), (p[on] * (1 - p[on])).sum(), (n[on] * p[on] * (1 - p[on])).sum()
        weight = 1 / min(max((seen - noise) / max(most, 1e-9), 1e-3), 0.5) - 1
        return dict(zip(groups, (s + weight * p) / (n + weight)))

    paths, hosts = {}, {}
    for d, (h, p) in of.items():
        for groups, k in ((paths, (h, p)), (hosts, h)):
            g = groups.setdefault(k, [0, 0])
            if d in known:
                g[0] += 1
                g[1] += known[d]
    top = (sum(known[d] for d in of if d in known) + 1) / (sum(d in known for d in of) + 2)
    host_rate = shrunk(hosts, dict.fromkeys(hosts, top))
    path_rate = shrunk(paths, {k: host_rate[k[0]] for k in paths})
    logit = lambda x: np.log(np.clip(x, 1e-4, 1 - 1e-4) / (1 - np.clip(x, 1e-4, 1 - 1e-4)))
    for r in quality.op8(spark, sf).collect():
        h, p = of[r.doc_id]
        assert abs(r.host_rate - host_rate[h]) < 1e-9 and abs(r.path_rate - path_rate[h, p]) < 1e-9
        assert abs(r.score - 1 / (1 + np.exp(-(logit(r.evidence) + logit(r.path_rate) - logit(top))))) < 1e-9
