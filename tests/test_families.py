import json

from pyspark.sql import functions as F

from tallyspark.operators import claims, merge
from tallyspark.plans import catalog, rollups, views
from tallyspark.plans.store import Ledger
from tallyspark.sources import families


def lines(spark, **files):
    return spark.createDataFrame([(p, i * 10, json.dumps(x)) for p, xs in files.items() for i, x in enumerate(xs)], "path string, offset long, line string")


def usage(i, c, w, o, r, t):
    return {"input_tokens": i, "cached_input_tokens": c, "cache_write_input_tokens": w, "output_tokens": o, "reasoning_output_tokens": r, "total_tokens": t}


def test_envelopes(spark):
    at = "2026-01-02T03:04:05Z"
    meta = {"type": "session_meta", "timestamp": at, "payload": {"id": "s1", "cwd": "/w", "model_provider": "openai"}}
    turn = lambda **x: {"type": "turn_context", "timestamp": at, "payload": x}
    record = lambda rid, u: {"type": "token_usage_record", "timestamp": at, "payload": {"thread_id": "t", "response_id": rid, "usage": u}}
    running = lambda u: {"type": "event_msg", "timestamp": at, "payload": {"type": "token_count", "info": {"total_token_usage": u}}}
    item = lambda k, a, b: {"type": "event_msg", "payload": {"type": "item_completed", "item": {"id": f"{k}{a}", "type": k, "started_at_ms": a, "completed_at_ms": b}}}
    new = [meta, turn(turn_id="1", model="gpt-5.5", cwd="/w/a"), record("r1", usage(10, 4, 0, 5, 1, 15)), running(usage(10, 4, 0, 5, 1, 15)), turn(turn_id="2"), record("r2", usage("10", 0, 0, 1, 0, 11)), record("r1", usage(10, 4, 0, 5, 1, 15))]
    old = [running(usage(100, 0, 0, 0, 0, 100)), running(usage(100, 0, 0, 0, 0, 100)), running(usage(130, 10, 0, 10, 0, 140)), running(usage(5, 0, 0, 0, 0, 5))]
    out = families.envelope_usage(lines(spark, new=new, old=old)).collect()
    by = sorted((r.session, r.turn or "", r.model, r.workspace or "", r.total, r.uncached, r.quality) for r in out)
    assert by == [("old", "", "unknown", "", 40, 20, "recorded"), ("s1", "1", "gpt-5.5", "/w/a", 15, 6, "recorded"), ("s1", "2", "unknown", "/w/a", 11, None, "partial")]
    w = families.envelope_work(lines(spark, a=[item("command_execution", 5, 9), item("reasoning", 3, 3), item("agentMessage", 1, 4), item("other", 1, 9)])).collect()
    assert sorted((r.kind, r.start_ms, r.end_ms) for r in w) == [("inference", 1, 4), ("tool", 5, 9)]


def test_running_totals_beside_records(spark):
    at = "2026-01-02T03:04:05Z"
    meta = lambda **x: {"type": "session_meta", "timestamp": at, "payload": {"id": "s", **x}}
    record = lambda rid, t: {"type": "token_usage_record", "timestamp": at, "payload": {"thread_id": "t", "response_id": rid, "usage": usage(t, 0, 0, 0, 0, t)}}
    running = lambda t: {"type": "event_msg", "timestamp": at, "payload": {"type": "token_count", "info": {"total_token_usage": usage(t, 0, 0, 0, 0, t)}}}
    files = {
        "mixed": [meta(), running(12), record("a", 7), running(31)],  # 12, 7, and 12 beyond the record
        "even": [meta(), record("b", 5), record("b", 5), running(5), running(5)],
        "tail": [meta(previousSessionFiles=["x"]), running(100), running(130), running(20), record("c", 4), running(25)],
        "less": [meta(), record("d", 9), running(5), running(8)],
    }
    out = families.envelope_usage(lines(spark, **files)).collect()
    assert sorted(r.total for r in out) == sorted([12, 7, 12, 5, 30, 4, 1, 9, 3])
    gaps = {(r.path, r.state): (r.checkpoints, r.epochs) for r in families.envelope_gaps(lines(spark, **files)).collect()}
    assert gaps == {("mixed", "billed"): (2, 1), ("even", "even"): (2, 1), ("tail", "unallocated-history"): (1, 1), ("tail", "billed"): (2, 2), ("tail", "counter-discontinuity"): (1, 2), ("less", "parse-gap"): (1, 1), ("less", "billed"): (1, 1)}


def test_a_copied_session_is_billed_once(spark):
    at = "2026-01-02T03:04:05Z"
    meta = lambda i, **x: {"type": "session_meta", "timestamp": at, "payload": {"id": i, **x}}
    record = lambda rid, t, n=None: {"type": "token_usage_record", "timestamp": at, "ordinal": n, "payload": {"response_id": rid, "usage": usage(t, 0, 0, 0, 0, t)}}
    running = lambda t, n=None: {"type": "event_msg", "timestamp": at, "ordinal": n, "payload": {"type": "token_count", "info": {"total_token_usage": usage(t, 0, 0, 0, 0, t)}}}
    body = [running(12, 1), record("r", 5, 2), record(None, 2, 3), running(24, 4)]
    item = {"type": "event_msg", "payload": {"type": "item_completed", "item": {"id": "i", "type": "plan", "started_at_ms": 1, "completed_at_ms": 4}}}
    files = {"a": [meta("s"), *body, item], "b": [meta("s"), *body, item], "fork": [meta("f", root_session_id="s"), *body, item], "other": [meta("o"), running(12, 1)]}
    out = families.envelope_usage(lines(spark, **files), "copier").collect()
    assert sorted(r.total for r in out) == [2, 5, 5, 12, 12] and {r.agent for r in out} == {"copier"}
    assert families.envelope_work(lines(spark, **files)).count() == 1
    later = {"next": [meta("n", previousSessionFiles=["a"]), record(None, 2, 3)], "a": files["a"]}
    known = spark.createDataFrame([("a", "s")], "path string, session string")
    assert sorted(r.total for r in families.envelope_usage(lines(spark, **later), rollouts=known).collect()) == [2, 5, 5, 12]
    assert sorted(r.total for r in families.envelope_usage(lines(spark, **later)).collect()) == [2, 2, 5, 5, 12]


def test_inputs_of_envelopes(spark):
    meta = lambda i, **x: {"type": "session_meta", "timestamp": 1000, "payload": {"id": i, "cwd": "/w", **x}}
    said = lambda i, items, at=2000: {"type": "response_item", "timestamp": at, "payload": {"type": "message", "role": "user", "id": i, "internal_chat_message_metadata_passthrough": {"content_item_kinds": items}}}
    files = {"a": [meta("s", originator="tui"), said("1", ["user.text", "x"]), said("2", ["agents_md.instructions"]), said("3", ["agents_md.instructions", 5]), said("4", []), said(None, ["user.text"])], "b": [meta("t"), said("1", ["user.text"]), said("2", ["agents_md.instructions"], 9000)]}
    parents = spark.createDataFrame([("t", "s")], "session string, parent string")
    each = families.envelope_inputs(lines(spark, **files), parents)
    assert {(r.native_input, r.session, r.lane) for r in each.collect()} == {*[(i, "s", "main") for i in "1234"], ("1", "t", "subagent"), ("2", "t", "subagent")}
    out = {r.native_input: (r.session, r.kind, r.controller, r.at_ms) for r in merge.merged(each).collect()}
    assert out == {"1": ("s", "submission", "tui", 2000), "2": ("s", "unknown", "tui", 2000), "3": ("s", "unknown", "tui", 2000), "4": ("s", "unknown", "tui", 2000)}


def test_flat_revisions(spark):
    row = lambda at, out, session="s": {"type": "assistant", "sessionId": session, "requestId": "q", "timestamp": at, "message": {"id": "m", "model": "claude-opus-5", "usage": {"input_tokens": 1, "cache_read_input_tokens": 2, "cache_creation_input_tokens": 3, "output_tokens": out}}}
    out = families.flat_usage(lines(spark, a=[row(2000, 4), row(3000, 9), row(4000, None), {"type": "user"}], b=[row(1000, 4, "copy")])).collect()
    assert [(r.total, r.session, r.at_ms, r.quality) for r in out] == [(15, "copy", 1000, "recorded")]


def test_headed_families(spark):
    head = lambda i, at: {"type": "session", "version": 3, "id": i, "cwd": "/w", "timestamp": at}
    msg = lambda r, t: {"type": "message", "message": {"role": "assistant", "responseId": r, "provider": "p", "model": "", "usage": {"input": 5, "cacheRead": 0, "cacheWrite": 0, "output": 5, "totalTokens": t}}}
    out = families.headed_usage(lines(spark, fork=[head("f", 2000), msg("a", 12), msg("b", 10)], root=[head("r", 1000), msg("a", 12)])).collect()
    assert sorted((r.session, r.total, r.model) for r in out) == [("f", 10, "unknown"), ("r", 12, "unknown")]


def test_tasks_take_a_bounded_number_of_envelope_lines(spark, monkeypatch):
    monkeypatch.setattr(families, "LINES", 40)
    rows = spark.range(960).select(F.concat(F.lit("/f"), F.col("id") % 96).alias("path"), "id", F.lit('{"type": "event_msg"}').alias("line")).withColumnRenamed("id", "offset")
    parts = [r["count"] for r in families.envelopes(rows).groupBy(F.spark_partition_id().alias("part")).count().collect()]
    assert sum(parts) == 960 and len(parts) > 12 and max(parts) <= 160


def test_claims(spark):
    i = spark.createDataFrame([("x", "s", "1", None), ("x", "s", "2", "human"), ("x", "s", "3", "human"), ("x", "s", "4", None), ("x", "s", "4", None), ("x", "s", None, None), ("x", "s", "5", None)], "agent string, native_session string, native_input string, native_origin string")
    c = spark.createDataFrame([("x", "s", "1", "human", "a"), ("x", "s", "1", "human", "a"), ("x", "s", "2", "automated", None), ("x", "s", "4", "human", None), ("x", "s", "5", "human", None), ("x", "s", "5", "automated", None), ("x", "s", "9", "human", None)], "agent string, native_session string, native_input string, origin string, controller string")
    out = sorted((r.native_input or "", r.evidence, r.origin_kind, r.controller) for r in claims.matched(i, c).collect())
    assert out == [("", "none", "unknown", None), ("1", "claim", "human", "a"), ("2", "conflict", "unknown", None), ("3", "source", "human", None), ("4", "ambiguous", "unknown", None), ("4", "ambiguous", "unknown", None), ("5", "conflict", "unknown", None)]
    assert [r.native_input for r in claims.pending(i, c).collect()] == ["9"]


def test_rollups_equal_a_full_build(spark, sf, tmp_path):
    old, new = catalog._changed(spark, sf)
    days = old.select(catalog.clock.local_date("at_ms", views.ZONE).cast("string").alias("date")).distinct()
    of = lambda facts: lambda todo: catalog._dated(facts).join(todo, "date", "left_semi").groupBy("date").agg(F.sum("total").alias("total"))
    store = Ledger(spark, str(tmp_path))
    none = spark.createDataFrame([], "day string")
    cutoff = "2024-01-20"
    first, n = rollups.refresh(store, days, none, "v1", cutoff, of(old))
    assert n == days.count() and first.count() == n
    again, n = rollups.refresh(store, days, none, "v1", cutoff, of(old))
    assert n == days.filter(F.col("date") >= cutoff).count() and sorted(again.collect()) == sorted(of(old)(days).collect())
    few = old.withColumn("total", F.when(F.col("at_ms") < 1_704_200_000_000, F.col("total") + 1).otherwise(F.col("total")))
    dirty = catalog.ledger.dirty_days(old, few, "origin", "at_ms", ["total"])
    out, n = rollups.refresh(store, days, dirty, "v1", cutoff, of(few))
    assert n < days.count() and sorted(out.collect()) == sorted(of(few)(days).collect())
    assert rollups.refresh(store, days, none, "v2", cutoff, of(few))[1] == days.count()
