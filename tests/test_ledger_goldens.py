"""Values worked out by hand for the operators, edge cases among them."""

from pyspark.sql import functions as F

from tallyspark.functions import clock, pricing, quality
from tallyspark.operators import dedup, intervals, scope, sequences
from tallyspark.plans import lineage

M = 60_000


def lanes(spark, *rows):
    return spark.createDataFrame(rows, "k int, lane string, start_ms long, end_ms long")


def test_sweep(spark):
    two = intervals.stats(lanes(spark, (1, "a", 0, 10 * M), (1, "b", 5 * M, 15 * M)), ["k"], ["lane"]).first()
    assert (two.active_ms, two.agent_ms, two.parallel_ms, two.histogram) == (15 * M, 20 * M, 5 * M, f"1:{10 * M},2:{5 * M}")
    same = intervals.stats(lanes(spark, (1, "a", 0, 10 * M), (1, "a", 5 * M, 12 * M), (1, "a", 12 * M, 20 * M)), ["k"], ["lane"]).first()
    assert (same.active_ms, same.agent_ms, same.parallel_ms) == (20 * M, 20 * M, 0)


def test_subtract(spark):
    out = intervals.subtract(lanes(spark, (1, "a", 0, 60)), lanes(spark, (1, "a", 20, 30), (1, "a", 25, 40), (1, "a", 55, 90)), "k", "lane").orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms) for r in out] == [(0, 20), (40, 55)]


def test_midnight_split_and_dst(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    day = spark.sql("select date'2026-11-01' d").select(clock.midnight("d", "America/New_York").alias("m")).first().m
    one = spark.createDataFrame([(day - 30 * M, day + 30 * M)], "start_ms long, end_ms long")
    out = intervals.fan_out(one, "America/New_York").orderBy("start_ms").collect()
    assert [(str(r.date), r.slot, r.end_ms - r.start_ms) for r in out] == [("2026-10-31", 23, 30 * M), ("2026-11-01", 0, 30 * M)]
    for date, n in (("2026-03-08", 23), ("2026-11-01", 25), ("2026-06-01", 24)):
        d = spark.sql(f"select date'{date}' date").select("date", clock.midnight("date", "America/New_York").alias("start_ms"), clock.midnight(F.date_add("date", 1), "America/New_York").alias("end_ms"))
        assert clock.slots(d).count() == n


def test_pricing(spark):
    def of(model, *n, provider="x"):
        row = spark.createDataFrame([(provider, model, *n, 0, sum(x or 0 for x in n))], "provider string, model string, uncached long, cache_read long, cache_write long, output long, reasoning long, total long")
        return pricing.priced(row).first()

    assert of("gpt-5.6-sol", 1000, 2000, 100, 500).nano_usd == 15_300_000
    assert of("gpt-5.6-sol", 272_000, 0, 0, 0).nano_usd == 272_000 * 4_000
    assert of("gpt-5.6-sol", 272_001, 0, 0, 0).nano_usd == 272_001 * 8_000
    assert of("nobody", 0, 0, 0, 0).nano_usd == 0 and of("nobody", 1, 0, 0, 0).why_unpriced == "unpriced-model"
    assert of("kimi-k3", 1, 0, 1, 0).why_unpriced == "unpriced-model" and of("gpt-5.5", 1, None, 0, 0).why_unpriced == "incomplete-token-breakdown"
    assert of("anthropic/claude-opus-5", 1, 0, 0, 0, provider="openrouter").nano_usd == 5_000
    assert of("k3", 1, 0, 0, 0, provider="moonshotai").nano_usd == 3_000 and of("k3", 1, 0, 0, 0).why_unpriced == "unpriced-model"
    assert of("gpt-5.6", 1, 0, 0, 0, provider="openai").nano_usd == 4_000 and of("gpt-5.6", 1, 0, 0, 0, provider="openrouter").why_unpriced == "unpriced-model"


def test_public_labels(spark):
    some = {"model(x)[y]": "model(x)[y]", "jo@firm.example": "unknown", "a b": "unknown", "gho_abcdef": "unknown", "GHS_x": "unknown", "a://b": "unknown", "x" * 128: "x" * 128, "x" * 129: "unknown", "a\n": "unknown", "": "unknown"}
    out = spark.createDataFrame([(k,) for k in some] + [(None,)], "x string").select("x", quality.public_label(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in out} == some | {None: "unknown"}


def test_records_that_come_in_one_by_one(spark):
    import itertools
    import random

    def fold(records):
        stays, conflict = None, False
        for n, (quality_, known, gap) in enumerate(records):
            new = {"n": n, "score": {"recorded": 100, "partial": 50, "unavailable": 0}[quality_] + 8 - known.count(None), "gap": gap, "told": known}
            if stays is None:
                stays = new
            elif new["score"] >= stays["score"]:
                if stays["gap"] or (new["score"] == stays["score"] and new["told"] != stays["told"]):
                    new, conflict = new | {"score": 58 - known.count(None), "gap": True}, True
                stays = new
        return stays["n"], stays["score"], conflict

    r = random.Random(2)
    kinds = list(itertools.product(("recorded", "partial", "unavailable"), ((1,) * 8, (2,) * 8, (None,) + (1,) * 7, (None, None) + (1,) * 6, (3, None) + (1,) * 6), (False, False, False, True)))
    keys = {k: [r.choice(kinds) for _ in range(r.randrange(1, 9))] for k in range(400)}
    rows = [(k, n, q, ["parse-gap"] if gap else [], *known, "p", "m", "c") for k, records in keys.items() for n, (q, known, gap) in enumerate(records)]
    schema = "key int, n int, quality string, reasons array<string>, " + ", ".join(f"{c} long" for c in dedup.COUNTED) + ", provider string, model string, cost_kind string"
    out = {r.key: (r.n, r.score, r.conflict) for r in dedup.by_arrival(spark.createDataFrame(rows, schema), ["key"], "n").collect()}
    assert out == {k: fold(records) for k, records in keys.items()}


def test_windows_add_up(spark):
    windows = spark.createDataFrame([(1, 60), (2, 60), (3, 60), (4, 60)], "k int, ms long")
    work = spark.createDataFrame([(1, "a", 0, 30, "inference"), (1, "b", 20, 40, "tool"), (4, "a", 0, 60, "tool")], "k int, lane string, start_ms long, end_ms long, kind string")
    out = {r.k: r for r in intervals.in_windows(windows, work, ["k"], ["lane"], F.col("ms"), F.col("k") == 2).collect()}
    assert (out[1].active_ms, out[1].inference_ms, out[1].agent_ms, out[1].parallel_ms, out[1].histogram) == (40, 30, 50, 10, "0:20,1:30,2:10")
    assert (out[2].active_ms, out[2].histogram, out[2].status) == (0, "0:60", "recorded") and (out[3].active_ms, out[3].histogram, out[3].status) == (None, None, "unavailable")
    assert out[4].histogram == "1:60" and out[4].inference_ms == 0


def test_metric_sums(spark):
    df = spark.createDataFrame([("a", 1, "recorded"), ("a", None, "recorded"), ("b", None, "recorded"), ("c", 5, "recorded"), ("d", 2**53 - 1, "recorded"), ("d", 1, "recorded"), ("e", 2, "recorded"), ("e", 3, "partial")], "k string, v long, quality string")
    out = {r.k: (r.v, r.v_status) for r in df.groupBy("k").agg(*quality.known_sum("v", "v")).collect()}
    assert out == {"a": (1, "partial"), "b": (None, "unavailable"), "c": (5, "recorded"), "d": (None, "partial"), "e": (5, "partial")}


def test_lineage(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 99), (6, 7), (7, 6)], "id long, parent long")
    out = {r.id: (r.root, r.depth) for r in lineage.roots(tree).collect()}
    assert out == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (5, 0), 6: (None, None), 7: (None, None)}


def test_counter_reset(spark):
    r = spark.createDataFrame([("c", i, v) for i, v in enumerate((100, 100, 140, 30, 50))], "key string, i int, reading long")
    out = sequences.counter_deltas(r, "key", "i").orderBy("i").collect()
    assert [(x.delta, x.epoch) for x in out] == [(100, 0), (0, 0), (40, 0), (0, 1), (20, 1)]


def test_scope(spark):
    cols = "id long, identities int, live_included boolean, live_known boolean, in_root boolean, historical boolean, cached boolean, path string"
    s = scope.decided(spark.createDataFrame([(1, 2, True, True, True, True, True, "/a"), (2, 1, True, True, False, False, False, "/a"), (3, 1, False, True, True, False, False, "/a"), (4, 0, False, False, True, False, False, "/a"), (5, 0, False, False, False, False, False, None), (6, 0, False, False, False, False, False, "/b"), (7, 0, False, False, False, False, None, None)], cols))
    assert [r.decision for r in s.orderBy("id").collect()] == ["unattributed", "included", "out-of-scope", "included", "unattributed", "out-of-scope", "unattributed"]
    roots = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4), (5, 2), (6, 2), (7, None)], "id long, root long")
    got = {r.id: (r.decision, r.scope_reason) for r in scope.inherited(s, roots).collect()}
    assert got[5] == ("included", "repository-identity") and got[6][0] == "out-of-scope" and got[7] == ("unattributed", "attribution-conflict")
    p = spark.createDataFrame([("/a/b", "/a"), ("/ab", "/a"), ("/a", "/a"), ("/a/b", "/a/")], "p string, r string")
    assert [r[0] for r in p.select(scope.within(F.col("p"), F.col("r"))).collect()] == [True, False, True, True]
