import json
import sqlite3

from pyspark.sql import functions as F

from tallyspark.plans.store import Ledger, replaced, upserted
from tallyspark.sources import jsonl, normalise, sqlite
from tallyspark.streaming import ingest


def test_jsonl_reads_whole_lines(spark, tmp_path):
    jsonl.register(spark)
    f = tmp_path / "a.jsonl"
    f.write_bytes(b'{"a": 1}\r\n\n  \nnot json\n{"a": "' + b"x" * 50 + b'"}\n{"a": 3}\n{"a": 4}')
    rows = spark.read.format("ledger_jsonl").option("path", str(tmp_path)).option("maxLineBytes", 40).load().orderBy("offset").collect()
    assert [(r.offset, r.line, r.gap) for r in rows] == [(0, '{"a": 1}', None), (14, None, "parse-gap"), (23, None, "oversize"), (83, '{"a": 3}', None)]


def test_pieces_give_each_line_once(tmp_path, monkeypatch):
    f = tmp_path / "a.jsonl"
    f.write_text("".join(json.dumps({"i": i, "x": "y" * (i % 37)}) + "\n" for i in range(300)))
    for part in (1, 7, 64, 10_000):
        monkeypatch.setattr(jsonl, "PART", part)
        got = [json.loads(r[2])["i"] for p in jsonl._pieces(str(f), 0, jsonl._whole_end(str(f)), None) for r in jsonl._lines(p, 1000)]
        assert got == list(range(300))


def test_cursors_detect_replay(tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text("1\n2\n")
    was = jsonl.cursor(str(f))
    f.write_text("1\n2\n3\nhalf")
    assert jsonl.resumed(str(f), was) == (4, None)
    f.write_text("1\n")
    assert jsonl.resumed(str(f), was) == (0, "truncated")
    f.write_text("9\n2\n3\n")
    assert jsonl.resumed(str(f), was)[1] == "prefix"
    assert jsonl.resumed(str(f), None) == (0, "new")


def test_stream_to_ledger(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    f = src / "a.jsonl"
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    parse = lambda b: b.select(F.get_json_object("line", "$.k").alias("k"), F.get_json_object("line", "$.v").cast("long").alias("v"), "offset")
    run = lambda: ingest.ingest(spark, str(src), ledger, "facts", ["k"], "offset", parse, str(tmp_path / "ck"))
    f.write_text('{"k": "a", "v": 1}\n{"k": "b", "v": 2}\n{"k": "a", "v": 3}\n{"k": "c"')
    run()
    assert {r.k: r.v for r in ledger.read("facts").collect()} == {"a": 3, "b": 2}
    with f.open("a") as x:
        x.write(', "v": 9}\n{"k": "b", "v": 5}\n')
    run()
    assert {r.k: r.v for r in ledger.read("facts").collect()} == {"a": 3, "b": 5, "c": 9}
    assert ledger.manifest()["version"] == 2


def test_ledger_commits(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    one = spark.createDataFrame([("r", 1), ("r", 2), ("s", 3)], "repo string, oid long")
    base = ledger.manifest()
    ledger.commit({"commits": one})
    try:
        ledger.commit({"commits": one}, base=base)
        raise AssertionError("a lost race must raise")
    except RuntimeError:
        pass
    now = replaced(ledger.read("commits"), spark.createDataFrame([("r", 7)], one.schema), "repo")
    assert sorted(map(tuple, now.collect())) == [("r", 7), ("s", 3)]
    put = upserted(one, spark.createDataFrame([("q", 2), ("z", 3)], one.schema), ["oid"])
    assert sorted(map(tuple, put.collect())) == [("q", 2), ("r", 1), ("z", 3)]


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "x.db")
    con = sqlite3.connect(path)
    con.execute("create table message(id text, n integer, t real, data json)")
    con.executemany("insert into message values (?,?,?,?)", [(f"m{i}", i if i % 5 else str(i) + "x", i / 2, json.dumps({"i": i})) for i in range(100)])
    con.commit()
    con.close()
    sqlite.register(spark)
    df = spark.read.format("ledger_sqlite").options(path=path, table="message", columns="n,id", where="t < 20", rows="7").load()
    assert df.dtypes == [("n", "bigint"), ("id", "string")]
    rows = df.collect()
    assert len(rows) == 40 and sum(r.n is None for r in rows) == 8
    assert sqlite.require(path, {"message": ["id", "gone"], "none": ["a"]}) == ["message.gone", "none.a"]


def test_usage_normalisers(spark):
    def of(f, *values):
        return spark.range(1).select(f(*[F.lit(v).cast("long") for v in values]).alias("u")).first().u

    a = of(normalise.inclusive_input, 100, 30, 10, 50, 20, 150)
    assert (a.uncached, a.total, a.quality) == (60, 150, "recorded")
    assert of(normalise.inclusive_input, 100, 130, 0, 50, 20, 150).quality == "partial"
    assert of(normalise.inclusive_input, 100, 30, 0, 50, 60, 150).reasoning is None
    b = of(normalise.disjoint, 1, 2, 3, 4, None)
    assert (b.total, b.quality) == (10, "recorded") and of(normalise.disjoint, 1, None, 3, 4, None).total is None
    c = of(normalise.with_residual, 1, 2, 3, 4, 0, 15)
    assert (c.total, c.quality) == (15, "recorded") and of(normalise.with_residual, 1, 2, 3, 4, 0, 5).total == 10
    d = of(normalise.reasoning_resolved, 10, 0, 0, 5, 3, 18)
    assert (d.output, d.reasoning, d.quality) == (8, 3, "recorded") and of(normalise.reasoning_resolved, 10, 0, 0, 5, 3, 15).output == 5
    assert of(normalise.cumulative, -1, 0, 0, 5, 3).uncached is None
