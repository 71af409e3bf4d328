import hashlib

import duckdb

from tallyspark.llm import lines


def brute(rows, long=lines.LONG, least=lines.DOCS):
    low = {c: c + 32 for c in range(65, 91)}
    split = [(d, [(x, x.strip(lines.WHITE).translate(low)) for x in (t or "").split("\n")]) for d, t in rows]
    found = {}
    for d, parts in split:
        for _, k in parts:
            if len(k) >= long and d is not None:
                found.setdefault(k, set()).add(d)
    heavy = {k: max(ds) for k, ds in found.items() if len(ds) >= least}
    out = []
    for d, parts in split:
        kept = [x for x, k in parts if k not in heavy or heavy[k] == d]
        out.append((d, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_whole_table_and_sql(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    con = duckdb.connect()
    con.execute(f"create view documents as from '{sf}/documents.parquet'")
    want = brute(rows)
    assert sum(r[2] for r in want) > 100
    assert told(lines.op13(spark, sf)) == want == sorted(con.execute(lines.SQL).fetchall(), key=repr)


def odd():
    line = "The Same Licence Line Stands In Many Documents"
    uml = "Über alle Zeilen hinweg STEHT dieser eine Satz İ"
    return [
        (1, None), (2, ""), (3, "\n"), *[(10 + i, f"own {i}\n  {line if i % 2 else line.upper()}\t\n{uml}\x0c\nend") for i in range(6)], (15, line),
        (None, f"{line}\nstays"), (None, line), (10, f"own 0\n  {line.upper()}\t\n{uml}\x0c\nend"), *[(20, f"{line.lower()}x")] * 7, (21, uml.replace("Ü", "ü") * 1), (22, f"{line}\n" * 20_000),
        (23, "k" * 200_000 + "\n" + line), (9, "short\n" * 50), *[(30 + i, "short line of 39 code points, so it stay") for i in range(6)], *[(40 + i, "short line of 39 code points, so it sta") for i in range(6)],
    ]


def test_edges_by_every_way(spark, monkeypatch):
    docs = spark.createDataFrame([(d, t, 5, "a", 1, 2) for d, t in odd()], "doc_id long, text string, n_lines int, _id string, drop int, h1 int")
    want = brute(odd())
    assert {(r[0], r[2]) for r in want if r[0] in (22, 23)} == {(22, 20_000), (23, 0)}
    for keys, rows in ((lines.KEYS, lines.ROWS), (0, 0)):
        monkeypatch.setattr(lines, "KEYS", keys)
        monkeypatch.setattr(lines, "ROWS", rows)
        out = lines.drop_lines(docs)
        assert out.columns == ["doc_id", "text", "_id", "drop", "h1", "n_lines", "n_dropped"]
        got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect()]
        assert sorted(got, key=repr) == want
    assert lines.drop_lines(docs.limit(0)).count() == 0


def test_no_python_on_the_way(spark, sf):
    plan = lines.op13(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
