import hashlib
import re

from pyspark.sql import functions as F

from tallyspark.llm import common, secrets

RAW = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def brute(text):
    order = list(RAW)
    spans = sorted((m.start(), order.index(k), k, m.end()) for k, (p, ok) in RAW.items() for m in p.finditer(text or "") if ok(m))
    told = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
    return (*(sum(s[2] == k for s in spans) for k in order), hashlib.sha256(told.encode()).hexdigest()), told


def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = secrets.op4(spark, sf).collect()
    assert len(out) == len(docs) and sum(r.n_hex for r in out) > 10
    for r in out:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == brute(docs[r.doc_id])[0]


def test_edges(spark):
    texts = [None, "", "é Token = \"abcdef\" PASSWD:x api_key='ABCDEF' toKen:=secret=abcdefg", "AKIA" * 9, "AKIA123 AKIA" + "0" * 16, "A" + "f" * 23 + "g" + "0" * 40, "ſecret=abcdefgh", "secret: " + "z" * 100_000]
    docs = spark.createDataFrame([(i, t, "b") for i, t in enumerate(texts)] + [(None, texts[2], "b"), (2, texts[2], "b")], "doc_id long, text string, blob string")
    out = secrets.findings_by_path(docs, secrets.update(docs)).collect()
    assert len(out) == docs.count()
    for r in out:
        want, told = brute(texts[2 if r.doc_id is None else r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == want and r.spans == told
    pem = secrets.scan("x -----BEGIN RSA PRIVATE KEY-----")
    assert pem == [("pem", 2, 33)]
    assert secrets.findings_by_path(docs.limit(0), secrets.update(docs.limit(0))).count() == 0


def test_only_unseen_pairs_are_scanned(spark):
    docs = spark.createDataFrame([(1, "token=aaaaaaa"), (2, "token=aaaaaaa"), (3, "b")], "doc_id long, text string")
    ledger = secrets.update(docs)
    assert ledger.count() == 2
    more = docs.union(spark.createDataFrame([(4, "new")], docs.schema))
    new = secrets.update(more, ledger)
    assert new.count() == 1
    assert secrets.findings_by_path(more, ledger.unionByName(new)).count() == 4
    assert secrets.update(more, ledger.withColumn("rules", F.lit(0))).count() == 3


def test_texts_that_a_bitmap_cannot_tell_are_scanned_once(spark, monkeypatch):
    monkeypatch.setattr(common, "BITS", common.PAGE)  # full: nearly every key may be bad
    monkeypatch.setattr(common, "FEW", 10)
    docs = spark.range(0, 60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("token=aaaaaaa")).otherwise(F.concat(F.lit("secret: abcdef"), F.col("id") % 20_000)).alias("text"))
    ledger = secrets.update(docs)
    assert ledger.count() == ledger.select("blob").distinct().count() == docs.select("text").distinct().count()
    rows = spark.range(0, 100_000).select(F.col("id").cast("string").alias("k"))
    some = rows.filter("k % 7 = 0")
    assert common.may_be_in(rows, some, "k").filter("not _may and k % 7 = 0").count() == 0
    assert sorted(r.k for r in common.meeting(rows, some, "k").collect()) == sorted(str(i) for i in range(0, 100_000, 7))
    monkeypatch.setattr(common, "BITS", 1 << 28)
    assert common.may_be_in(rows, some, "k").filter("_may and k % 7 <> 0").count() < 3000
    assert secrets.update(docs, ledger).count() == 0
