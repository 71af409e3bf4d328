import duckdb

from tallyspark.llm import rules


def brute(text):
    t = text or ""
    w = [x for x in "".join(" " if c in rules.WHITE else c for c in t).split(" ") if x]
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    rep = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in t.split("\n") if x.strip(rules.WHITE)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in rules.SYMBOLS), len(lines) - len(set(lines)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as from '{sf}/documents.parquet'")
    cols = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept"
    want = con.execute(f"select {cols} from ({rules.SQL})").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in rules.op6(spark, sf).select(*cols.split(", ")).collect())


def test_edges(spark):
    texts = [None, "", " \n\t ", "a b c d e", "a b c d e " * 2, "x " * 9, "é # $\n\x0bé # $\n \né # $", "one\x0ctwo\rthree\x85four five", "w " * 30_000, "a b c d e f a b c d e f g a b c d"]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(None, "a", 7), (3, texts[3], 7)], "doc_id long, text string, n_words int")
    out = rules.apply(rules.ledger(docs), 2).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute("a" if r.doc_id is None else texts[r.doc_id])
    assert rules.ledger(docs.limit(0)).count() == 0


def test_ablation(spark, sf):
    book = rules.ledger(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    bits = [r.failed for r in book.collect()]
    whole = rules.mask(rules.POLICIES[2])
    for r in rules.ablation(book, 2).collect():
        b = rules.bit(r.rule)
        assert r.rejects == sum(bool(x & b) for x in bits)
        assert r.rejects_alone == sum(x & whole == b for x in bits)
        assert r.kept_without == sum(not x & whole & ~b for x in bits)
