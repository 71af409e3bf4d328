import hashlib
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import middle


def brute(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not t or re.search("<[PSM]>", t) or h3 % 100 >= 90:
        return doc_id, len(t), "plain", None, None, sha(t), sha(t)
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}" if form == "spm" else f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"
    return doc_id, len(t), form, a, b - a, sha(out), sha(t)


def test_whole_table_and_sql(spark, sf):
    want = sorted(brute(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    con = duckdb.connect()
    con.execute(f"create view documents as from '{sf}/documents.parquet'")
    key = "doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256"
    assert sorted(tuple(r) for r in middle.op11(spark, sf).collect()) == want
    assert sorted(con.execute(f"select {key} from ({middle.SQL})").fetchall()) == want
    forms = [r[2] for r in want]
    assert 0.05 < forms.count("plain") / len(forms) < 0.2 and 0.1 < forms.count("spm") / len(forms) < 0.3


def test_edges(spark, tmp_path):
    texts = [None, "", "<", "<P", "a<P>b", "x<S><M>", "é\U0001f600<<P<S<M>>", "<<<<<<SP>M>", "ab\r\n\x0b", "x" * 300_000 + "é", " ", "\n", ">", "S>M>P>"]
    rows = [(i + k * 100, t, "c", "d") for k in range(12) for i, t in enumerate(texts)] + [(None, "of no id", "c", "d")] * 2 + [(2, "<", "c", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, restored string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((tuple(r) for r in middle.op11(spark, str(tmp_path)).collect()), key=repr) == sorted((brute(d, t) for d, t, *_ in rows), key=repr)
    kept = middle.transform(docs.withColumn("more", docs.doc_id))
    assert kept.columns == ["doc_id", "text", "restored", "more", *middle._SET]
    assert all(r.restored == (r.text or "") for r in middle.restore(kept).collect())
    assert middle.restore(middle.transform(docs.limit(0))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab é\n\t<PSM>1,"), max_size=40))
def test_ranks_against_listed_units(text):
    """Places from runs equal those of units listed one by one, for several ways to count."""
    for units, pattern in (
        (middle.CODE_POINTS, r"[\s\S]"), (middle.WORDS, r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+"),
        (middle.Units((("1,", 2), (" ", None)), 3), r"[1,]{1,2}|\x20+|[^1,\x20]{1,3}"), (middle.Units((("\n", 1),), None), r"\n|[^\n]+"),
    ):
        ends = [0, *(m.end() for m in re.finditer(pattern, text))]
        ranks = middle.Ranks(text, units, units.automaton())
        assert ranks.count == len(ends) - 1 and [ranks.place(k) for k in range(len(ends))] == ends
        assert [s for _, s in ranks.sentinels] == re.findall("<[PSM]>", text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("<PSM>a"), max_size=12), st.integers(0, 500))
def test_round_trip(text, doc_id):
    automaton = middle.CODE_POINTS.automaton()
    form, _, _, output = middle.cut(text, doc_id, middle.CODE_POINTS, automaton)
    assert middle.rebuilt(output, form, automaton) == text
