import corpus_pipeline
from tallyspark.llm import common, decontaminate, pii
from test_minhash import brute
from test_packing import gapless


def test_stages_on_the_whole_table(spark, sf, tmp_path):
    docs = first = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [{r.doc_id: r.text for r in first.collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, sf)
        assert docs.columns == first.columns and docs.dtypes == first.dtypes
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows = docs.collect()
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
        seen.append({r.doc_id: r.text for r in rows})
    calm, single, clean, masked = seen[1:]
    toxic = {r.doc_id for r in common.table(spark, sf, "labels").filter("toxic = 1").collect()}
    assert len(toxic & set(calm)) < 0.2 * len(toxic) and len(seen[0]) - len(calm) < 0.2 * len(seen[0])
    assert set(single) == {d for d, (_, _, kept) in brute(list(calm.items()), corpus_pipeline.SIMILAR).items() if kept}
    hit = decontaminate.contamination(spark.createDataFrame(list(clean.items()), "doc_id long, text string"), common.table(spark, sf, "benchmark"))
    assert hit.filter("contaminated").count() == 0
    untouched = decontaminate.contamination(spark.createDataFrame(list(single.items()), "doc_id long, text string"), common.table(spark, sf, "benchmark")).filter("not contaminated")
    assert all(clean[r.doc_id] == single[r.doc_id] for r in untouched.collect())
    left = pii.digest(spark.createDataFrame(list(masked.items()), "doc_id long, text string"))
    assert left.filter("n_email > 0 or n_ip > 0 or n_card > 0 or n_phone > 0").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == set(masked)
    gapless(packed)


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100


def test_near_copies_from_four_fifths_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = {d for d, (_, _, kept) in brute(rows, 80).items() if kept}
    assert want < {d for d, (_, _, kept) in brute(rows, 85).items() if kept}
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()} == want


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and empty texts, null and repeated ids, repeated rows, long texts, clashing columns and empty tables."""
    item = " ".join(f"w{i}" for i in range(12))
    long = " ".join(f"v{i % 997}x" for i in range(30_000))
    some = [(1, None), (2, ""), (3, "mail a@b.example now and then"), (3, "mail a@b.example now and then"), (4, f"before {item} after " + "more " * 30), (5, item), (None, "no id here at all my friends"), (6, long), (7, long), (8, long + " end"), (4, "another text of the same id")]
    rows = [(d, t, "en", None, None if t is None else len(t), 1, "a", "b", "c", None, 2) for d, t in some]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, h string, rid string, _hits binary, _row int"
    spark.createDataFrame([(i, 1, 0) for i in range(3)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    stages = dict(corpus_pipeline.STAGES)
    told = {}
    for name in ("toxicity", "near_dedup", "decontamination", "pii"):
        for table in (docs, docs.limit(0)):
            out = stages[name](spark, table, str(tmp_path))
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            told[name] = out.collect() if table is docs else told[name]
            assert table is docs or out.count() == 0
        assert all(r.n_chars == (None if r.text is None else len(r.text)) and (r.size, r.key, r.h, r.rid, r._row) == (1, "a", "b", "c", 2) for r in told[name])
    assert len(told["toxicity"]) == len(rows)
    assert sorted((r.doc_id or 0, r.text) for r in told["near_dedup"] if r.text) == sorted((d or 0, t) for d, t in some if t and d not in (7, 8))
    clean = {(r.doc_id, r.text) for r in told["decontamination"]}
    assert (1, None) in clean and (2, "") in clean and not any(d == 5 for d, _ in clean) and (4, "before  after " + "more " * 30) in clean and len(told["decontamination"]) == len(rows) - 1
    assert [r.text for r in told["pii"] if r.doc_id == 3] == ["mail [EMAIL] now and then"] * 2 and len(told["pii"]) == len(rows)
    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert len({r.doc_id for r in packed}) == 9 and sum(r.length for r in packed if r.doc_id in (1, 2)) == 2
    assert stages["packing"](spark, docs.limit(0), str(tmp_path)).count() == 0
