"""Counters with state between runs, over stores made here."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import cumulative
from tallyspark.plans import state
from tallyspark.sources import stores

ZONE = "America/New_York"
DAY = 86_400
NOON = 1_767_286_800.0  # 2026-01-01T12:00 in New York

MODEL = ("session_id", "model", "billing_provider", "task", "input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens", "reasoning_tokens", "cost_status", "actual_cost_usd", "estimated_cost_usd", "first_seen", "last_seen")


def store(path, sessions, models):
    con = sqlite3.connect(path)
    con.execute("drop table if exists sessions")
    con.execute("drop table if exists session_model_usage")
    con.execute("create table sessions (id TEXT, source TEXT, parent_session_id TEXT, model TEXT, started_at REAL, ended_at REAL, last_activity_at REAL, cwd TEXT, git_repo_root TEXT, billing_provider TEXT, input_tokens INTEGER, cache_read_tokens INTEGER, cache_write_tokens INTEGER, output_tokens INTEGER, reasoning_tokens INTEGER)")
    con.execute("create table session_model_usage (session_id TEXT, model TEXT, billing_provider TEXT, task TEXT, input_tokens INTEGER, cache_read_tokens INTEGER, cache_write_tokens INTEGER, output_tokens INTEGER, reasoning_tokens INTEGER, cost_status TEXT, actual_cost_usd REAL, estimated_cost_usd REAL, first_seen REAL, last_seen REAL)")
    con.executemany(f"insert into sessions values ({','.join('?' * 15)})", sessions)
    con.executemany(f"insert into session_model_usage values ({','.join('?' * 14)})", models)
    con.commit()
    con.close()


def session(ident, started=NOON, last=NOON + 60, counts=(0, 0, 0, 0, 0), ended=None):
    return (ident, "cli", None, "m", started, ended, last, "/w", None, "p", *counts)


def model(ident, counts, first=NOON, last=NOON + 60, name="m", provider="p", task="", money=(None, None, None)):
    return (ident, name, provider, task, *counts, *money, first, last)


def run(spark, folder, paths, number, at=NOON + 2 * DAY):
    def step(was):
        tables = stores.cumulative(spark, [str(p) for p in paths])
        observed = cumulative.counters(tables["sessions"], tables["session_model_usage"], int(at * 1000))
        usage, now = cumulative.step(observed, was["counters"], ZONE, int(at * 1000))
        return {"usage": usage, "counters": now}

    made = state.advance(spark, str(folder), number, ("counters",), step)
    return sorted(made["usage"].collect(), key=repr), {r.counter: r for r in made["counters"].collect()}


def test_growth_of_one_day_is_billed_once(spark, tmp_path):
    db = tmp_path / "a.db"
    store(db, [session("s", counts=(10, 0, 0, 5, 1))], [model("s", (10, 0, 0, 5, 1))])
    (first,), held = run(spark, tmp_path / "st", [db], 1)
    assert (first.total, first.at_ms, first.quality, first.epoch, first.reasons) == (15, int((NOON + 60) * 1000), "recorded", 0, [])
    assert run(spark, tmp_path / "st", [db], 2)[0] == []
    store(db, [session("s", counts=(17, 0, 0, 9, 1), last=NOON + 120)], [model("s", (17, 0, 0, 9, 1), last=NOON + 120)])
    (grown,), _ = run(spark, tmp_path / "st", [db], 3)
    assert (grown.uncached, grown.output, grown.reasoning, grown.total) == (7, 4, 0, 11) and grown.origin != first.origin
    again, _ = run(spark, tmp_path / "st", [db], 3)  # a run that is done again begins where the one before ended
    assert again == [grown]
    assert run(spark, tmp_path / "st", [db], 4)[0] == []


def test_growth_over_midnight_is_kept_undated(spark, tmp_path):
    db = tmp_path / "a.db"
    store(db, [session("s")], [model("s", (1, 1, 1, 1, 0), first=NOON, last=NOON + DAY)])
    (old,), _ = run(spark, tmp_path / "st", [db], 1)
    assert (old.total, old.at_ms, old.quality, old.reasons) == (4, None, "partial", ["unallocated-history"])
    store(db, [session("s")], [model("s", (3, 1, 1, 1, 0), first=NOON, last=NOON + 2 * DAY)])
    (more,), _ = run(spark, tmp_path / "st", [db], 2)
    assert (more.total, more.at_ms, more.reasons) == (2, None, ["unallocated-history"])


def test_a_fall_is_never_billed(spark, tmp_path):
    db = tmp_path / "a.db"
    store(db, [session("s")], [model("s", (9, 0, 0, 9, 0))])
    run(spark, tmp_path / "st", [db], 1)
    store(db, [session("s")], [model("s", (2, 0, 0, 12, 0), last=NOON + 90)])
    usage, held = run(spark, tmp_path / "st", [db], 2)
    assert usage == [] and [r.epoch for r in held.values()] == [1]
    store(db, [session("s")], [model("s", (5, 0, 0, 12, 0), last=NOON + 95)])
    (after,), held = run(spark, tmp_path / "st", [db], 3)
    assert (after.total, after.epoch) == (3, 1)


def test_routes_that_are_not_billed(spark, tmp_path):
    db = tmp_path / "a.db"
    store(db, [session("s")], [model("s", (1, 0, 0, 1, 0), provider="OpenAI-Codex"), model("s", (2, 0, 0, 1, 0), provider="auto", task="title"), model("s", (4, 0, 0, 1, 0), provider="auto")])
    usage, held = run(spark, tmp_path / "st", [db], 1)
    assert len(held) == 3
    assert sorted((r.total, r.at_ms is None, r.reasons) for r in usage) == [(3, True, ["unallocated-history"]), (5, False, [])]


def test_costs_and_gaps(spark, tmp_path):
    db = tmp_path / "a.db"
    rows = [
        model("s", (1, 0, 0, 1, 9), name="a", money=("actual", 0.0000015, None)), model("s", (1, None, 0, 1, 0), name="b", money=("Estimated", None, 2.5)), model("s", (1, 0, 0, 0, 0), name="c", money=("included", 1.0, 1.0)),
        model("s", (1, 0, 0, 0, 0), name="d", money=("actual", None, 1.0)), model("s", ("7", 0, 0, 1, 0), name="e"), model("s", (1, 0, 0, 1, 0), name="f", first=None),
    ]
    store(db, [session("s")], rows)
    usage, _ = run(spark, tmp_path / "st", [db], 1)
    got = {r.model: r for r in usage}
    assert (got["a"].cost_micro, got["a"].cost_kind, got["a"].reasoning, got["a"].reasons) == (2, "provider-reported", None, ["parse-gap"])
    assert (got["b"].cost_micro, got["b"].cost_kind, got["b"].total) == (2_500_000, "source-estimate", None)
    assert (got["c"].cost_micro, got["c"].cost_kind) == (None, "included") and (got["d"].cost_kind, got["d"].quality) == ("unknown", "recorded")
    assert got["f"].at_ms is None and got["f"].reasons == ["parse-gap", "unallocated-history"]


def test_residual_of_a_session(spark, tmp_path):
    db = tmp_path / "a.db"
    store(db, [session("s", counts=(10, 2, 0, 5, 0)), session("t", counts=(1, 0, 0, 0, 0)), session("u", counts=(4, 0, 0, 0, 0), ended=NOON + 30)], [model("s", (6, 2, 0, 5, 0)), model("s", (3, 0, 0, 0, 0), task="title"), model("t", (2, 0, 0, 0, 0))])
    usage, held = run(spark, tmp_path / "st", [db], 1)
    rest = {r.session: r for r in usage if r.model == "unknown"}
    assert set(rest) == {"s", "u"} and rest["s"].total == 4 and rest["u"].total == 4 and rest["u"].at_ms == int((NOON + 30) * 1000)


def test_copies_in_several_stores(spark, tmp_path):
    a, b, c = (tmp_path / f"{x}.db" for x in "abc")
    store(a, [session("s", counts=(5, 0, 0, 5, 0)), session("x", counts=(5, 0, 0, 1, 0), last=NOON + 90)], [model("s", (5, 0, 0, 5, 0)), model("x", (5, 0, 0, 1, 0), last=NOON + 90)])
    store(b, [session("s", counts=(8, 0, 0, 9, 0)), session("x", counts=(4, 0, 0, 9, 0))], [model("s", (8, 0, 0, 9, 0)), model("x", (4, 0, 0, 9, 0))])
    store(c, [session("s", started=NOON - 5, counts=(1, 0, 0, 1, 0))], [])
    usage, held = run(spark, tmp_path / "st", [a, b, c], 1)
    assert sorted((r.session, r.total, r.reasons) for r in usage) == [("s", 2, []), ("s", 17, []), ("x", 6, ["duplicate-ambiguity"])]
    assert run(spark, tmp_path / "st", [c, b, a], 2)[0] == []


def test_readings_after_the_cutoff_and_lost_stores(spark, tmp_path):
    a, b = tmp_path / "a.db", tmp_path / "b.db"
    store(a, [session("s")], [model("s", (1, 0, 0, 1, 0))])
    store(b, [session("t")], [model("t", (1, 0, 0, 1, 0), last=NOON + 3 * DAY)])
    usage, held = run(spark, tmp_path / "st", [a, b], 1)
    assert [r.session for r in usage] == ["s"] and len(held) == 1
    usage, held = run(spark, tmp_path / "st", [b], 2, at=NOON + 4 * DAY)
    assert [(r.session, r.at_ms) for r in usage] == [("t", None)] and len(held) == 2


def test_history_equals_run_by_run(spark, sf, tmp_path):
    from tallyspark.plans import stateful

    readings = stateful.readings(spark, sf).filter("session % 5 = 0").cache()
    times = [r[0] for r in readings.select("observed_ms").distinct().orderBy("observed_ms").collect()]
    usage = lambda df: sorted((r.origin, r.counter, r.at_ms, r.epoch, r.total, r.cost_micro, r.quality) for r in df.collect())
    got, held = [], None
    for k, at in enumerate(times[:6]):
        new, held = cumulative.step(readings.filter(F.col("observed_ms") == at).drop("observed_ms"), held, ZONE, at)
        got += usage(new)
        held = state.put(held, str(tmp_path), "counters", k)
    assert sorted(got, key=repr) == sorted(usage(cumulative.history(readings.filter(F.col("observed_ms") <= times[5]), ZONE)), key=repr) and len(got) > 50


def test_probe(tmp_path):
    good, bad = tmp_path / "good.db", tmp_path / "bad.db"
    store(good, [], [])
    con = sqlite3.connect(bad)
    con.execute("create table sessions (id TEXT)")
    con.execute("create table session_model_usage (model TEXT)")
    con.close()
    assert stores.probe(str(good), "cumulative") == [] and stores.probe(str(bad), "cumulative") == ["sessions.source", "sessions.started_at", "session_model_usage.session_id"]
    messages = tmp_path / "m.db"
    con = sqlite3.connect(messages)
    for t, columns in stores.MESSAGES.items():
        con.execute(f"create table {t} ({', '.join(columns)})")
    con.execute("create table session_message (id)")
    assert stores.probe(str(messages), "messages") == []
    con.execute("insert into session_message values (1)")
    con.commit()
    assert stores.probe(str(messages), "messages") == ["message"]
    con.execute("insert into message values ('m', 's', 1, 1, '{}')")
    con.execute("create index i1 on message (session_id, time_created, id)")
    con.execute("create index i2 on part (message_id, id)")
    con.commit()
    assert stores.probe(str(messages), "messages") == ["part(session_id)"]
    with pytest.raises(KeyError):
        stores.probe(str(messages), "other")
