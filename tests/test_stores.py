"""The message store between runs, clone ownership, input merges, claims and fork families, over small cases made here."""

import json
import random
import sqlite3

from pyspark.sql import functions as F

from tallyspark.operators import claims, clones, dedup, forks, kinds, merge, messages
from tallyspark.plans import lineage, state
from tallyspark.sources import stores

# ---- message store


def store(path, sessions, rows, parts):
    con = sqlite3.connect(path)
    for t, columns in stores.MESSAGES.items():
        con.execute(f"drop table if exists {t}")
        con.execute(f"create table {t} ({', '.join(f'{c} {dict(long='INTEGER', string='TEXT')[k]}' for c, k in columns.items())})")
    con.executemany("insert into session values (?, '/w', null, ?, ?)", sessions)
    con.executemany("insert into message values (?, ?, ?, ?, ?)", [(*r[:4], json.dumps(r[4])) for r in rows])
    con.executemany("insert into part values (?, ?, ?, ?, ?, ?)", [(*r[:5], json.dumps(r[5])) for r in parts])
    con.commit()
    con.close()


def user(at):
    return {"role": "user", "time": {"created": at}, "agent": "build", "model": {"id": "m"}, "summary": {}}


def assistant(at, done=None, tokens=(1, 0, 0, 2, 0, 3)):
    t = dict(zip(("input", "output", "reasoning", "total"), (tokens[0], tokens[3], tokens[4], tokens[5])), cache={"read": tokens[1], "write": tokens[2]})
    return {"role": "assistant", "providerID": "p", "modelID": "m", "time": {"created": at} | ({"completed": done} if done else {}), "tokens": t, "cost": 0.5}


def text(ident, message, session="s", said="hello"):
    return (ident, message, session, 1, 1, {"type": "text", "text": said})


def run(spark, db, folder, number, cutoff=10_000):
    tables = {t: stores.read(spark, str(db), t, c, "time_created <= 10000" if t == "message" else "1") for t, c in stores.MESSAGES.items()}
    sessions = tables["session"].select(F.col("id").alias("session"), F.col("time_updated").alias("updated_ms"))
    rows = tables["message"].select(F.col("session_id").alias("session"), F.col("id").alias("message"), F.get_json_object("data", "$.role").alias("role"), F.col("time_created").alias("created_ms"), F.col("time_updated").alias("updated_ms"), "data")
    parts = tables["part"].select(F.col("session_id").alias("session"), F.col("message_id").alias("message"), F.col("id").alias("part"), "data")

    def step(was):
        marks, seen = was["marks"], was["seen"]
        marks = spark.createDataFrame([], messages.WATERMARKS) if marks is None else marks
        seen = spark.createDataFrame([], messages.SEEN) if seen is None else seen
        done = messages.normalised(messages.with_parts(messages.due(sessions, rows, marks, seen, cutoff), parts))
        marks, seen = messages.remembered(done, sessions, marks, seen)
        return {"done": done, "marks": marks, "seen": seen}

    made = state.advance(spark, str(folder), number, ("marks", "seen"), step)
    return {r.message: r for r in made["done"].collect()}, {r.message: r for r in made["seen"].collect()}


def test_messages_are_read_again_only_where_they_must(spark, tmp_path):
    db, folder = tmp_path / "m.db", tmp_path / "state"
    rows = [("u1", "s", 1000, 1000, user(1000)), ("a1", "s", 1100, 1100, assistant(1100)), ("a2", "s", 1200, 1200, assistant(1200, 1250)), ("late", "s", 20_000, 20_000, user(20_000))]
    parts = [text("p1", "u1"), ("p2", "a1", "s", 1, 1, {"type": "step-finish", "id": "x"})]
    store(db, [("s", 900, 1), ("t", 900, 1)], rows, parts)
    first, seen = run(spark, db, folder, 1)
    assert set(first) == {"u1", "a1", "a2"} and all(r.account and r.needs_parts for r in first.values())
    assert (first["u1"].kind, first["a2"].u.total, first["a2"].cost_micro, first["a1"].partial, first["a2"].partial) == ("submission", 3, 500_000, True, False)
    assert run(spark, db, folder, 2)[0] == {}  # no session changed
    # The session changed: the open message is complete, another came in the watermark's millisecond, an old one is as it was.
    rows[1] = ("a1", "s", 1100, 1100, assistant(1100, 1150))
    rows.append(("a3", "s", 1200, 1200, assistant(1200, 1300)))
    store(db, [("s", 900, 2), ("t", 900, 1)], rows, parts)
    again, now = run(spark, db, folder, 3)
    assert {m: (r.account, r.needs_parts) for m, r in again.items()} == {"u1": (False, True), "a1": (True, True), "a2": (True, False), "a3": (True, True)}
    assert again["a2"].print == first["a2"].print == now["a2"].print and again["a1"].print != first["a1"].print and again["u1"].print == first["u1"].print
    assert not now["a1"].partial and len(now) == 4
    store(db, [("s", 900, 3)], rows, parts)
    assert {m: r.account for m, r in run(spark, db, folder, 4)[0].items()} == {"u1": False, "a1": False, "a2": True, "a3": True}


def test_kinds_of_stored_inputs(spark, tmp_path):
    db = tmp_path / "m.db"
    rows = [(m, "s", 1, 1, user(1)) for m in ("plain", "file", "none", "empty", "more")] + [("odd", "s", 1, 1, user(1) | {"x": 1})]
    parts = [text("a", "plain"), ("b", "file", "s", 1, 1, {"type": "file", "path": "/x"}), text("c", "empty", said=""), ("d", "more", "s", 1, 1, {"type": "text", "text": "x", "synthetic": True}), text("e", "odd"), text("f", "file")]
    store(db, [("s", 1, 1)], rows, parts)
    got, _ = run(spark, db, tmp_path / "st", 1)
    assert {m: r.kind for m, r in got.items()} == {"plain": "submission"} | dict.fromkeys(("file", "none", "empty", "more", "odd"), "unknown")


def test_prints_of_content(spark):
    same = [('{"a": 1.0, "id": 5, "b": [1e2]}', '{"b": [100], "a": 1}'), ('{"x": 9007199254740993}', '{"x": 9007199254740992}'), ('"\\u00e9"', '"é"'), ("1e21", "1000000000000000000000"), ("-0.0", "0"), ("1e-7", "0.0000001")]
    other = [('{"a": 1}', '{"a": "1"}'), ("NaN", "null"), ('{"a": null}', "{}"), ("[1, 2]", "[2, 1]")]
    rows = spark.createDataFrame(same + other, "a string, b string").select("a", *[kinds.content_print(F.col(c), ("id",)).alias(f"p{c}") for c in "ab"]).collect()
    assert [r.pa == r.pb for r in rows] == [True] * len(same) + [False] * len(other)
    assert kinds._number(123456789012345680000.0) == "123456789012345680000" and kinds._number(1.5e300) == "1.5e+300" and kinds._number(-1.25e-9) == "-1.25e-9" and kinds._number(0.000001) == "0.000001" and kinds._number(12.5) == "12.5"
    order = spark.createDataFrame([('{"\U0001f600": 1, "￿": 2}', '{"￿": 2, "\U0001f600": 1}')], "a string, b string").select(*[kinds.content_print(F.col(c)).alias(c) for c in "ab"]).first()
    assert order.a == order.b and kinds._stable({"￿": 1.0, "\U0001f600": 2.0}, frozenset()).startswith('{"\U0001f600"')


# ---- clone ownership

TURNS = "session string, pos int, print string, role string, started_ms long, counted boolean"


def sequence(session, started, prints):
    return [(session, k, p, "user" if p.startswith("u") else "assistant", started, p.startswith("a")) for k, p in enumerate(prints, 1)]


def memory_run(spark, folder, number, rows, stored):
    turns = spark.createDataFrame(rows, TURNS)

    def step(was):
        memory = spark.createDataFrame([], "print string, owner string") if was["memory"] is None else was["memory"]
        canonical, duplicates, promoted = clones.owners(turns, memory, spark.createDataFrame(stored, "session string, started_ms long"))
        lost = clones.ambiguous(turns, duplicates, memory)
        return {"canonical": canonical, "lost": lost, "replays": clones.replays(promoted), "memory": clones.remembered(turns, memory, canonical, promoted)}

    made = state.advance(spark, str(folder), number, ("memory",), step)
    return [{tuple(r) for r in made[k].collect()} for k in ("canonical", "lost", "replays", "memory")]


def test_an_older_original_takes_its_turns_back(spark, tmp_path):
    copy, original = sequence("copy", 2000, ["u1", "a1", "a9"]), sequence("orig", 1000, ["u1", "a1", "a2"])
    canonical, lost, replays, memory = memory_run(spark, tmp_path, 1, copy, [])
    assert (canonical, lost, replays) == (set(), set(), set()) and memory == {("u1", "copy"), ("a1", "copy"), ("a9", "copy")}
    canonical, lost, replays, memory = memory_run(spark, tmp_path, 2, original, [("copy", 2000)])
    assert canonical == {("copy", "orig")} and replays == {("copy", 2)} and memory == {("u1", "orig"), ("a1", "orig"), ("a2", "orig"), ("a9", "copy")}
    younger = sequence("late", 3000, ["u1", "a1", "a7"])
    canonical, lost, replays, memory = memory_run(spark, tmp_path, 3, younger, [("copy", 2000), ("orig", 1000)])
    assert canonical == {("late", "orig")} and lost == set() and replays == set() and ("a7", "orig") in memory


def test_what_makes_a_copy(spark, tmp_path):
    memory_run(spark, tmp_path, 1, sequence("a", 1, ["u1", "u2", "a1", "a2"]), [])
    cases = {"one": ["u1", "a8"], "talk": ["u1", "u2", "a8"], "gap": ["u9", "u2", "a1"], "whole": ["u1", "u2", "a1", "a8"]}
    rows = [r for k, (name, prints) in enumerate(cases.items()) for r in sequence(name, 10 + k, [p if p != "a8" else f"a8{name}" for p in prints])]
    canonical, lost, _, _ = memory_run(spark, tmp_path, 2, rows, [("a", 1)])
    assert ("whole", "a") in canonical and {s for s, _ in canonical} & {"one", "talk", "gap"} <= {"talk"}
    assert ("gap", 3) in lost and not any(s == "whole" for s, _ in lost)


def test_single_duplicates_are_left_out(spark, tmp_path):
    rows = sequence("first", 1000, ["a1"]) + sequence("second", 2000, ["a1"]) + sequence("third", 500, ["u1", "a1"])
    canonical, lost, _, _ = memory_run(spark, tmp_path, 1, rows, [])
    assert canonical == set() and lost == {("first", 1), ("second", 1)}


def test_long_conversations_cost_a_turn_each(spark):
    n = 20_000
    turns = spark.range(2 * n).select((F.col("id") % 2).alias("conv_id"), F.expr("id div 2").alias("turn"), F.when(F.expr("id div 2") < n - 1, F.concat(F.lit("p"), F.expr("id div 2"))).otherwise(F.concat(F.lit("q"), F.col("id"))).alias("print"), F.lit("assistant").alias("role"))
    assert [tuple(r) for r in dedup.common_prefix(turns).orderBy("conv_id").collect()] == [(0, n - 1, 0, 2), (1, n - 1, 0, 2)]
    assert [tuple(r) for r in dedup.clones(turns).collect()] == [(1, 0, n - 1)]


# ---- merged inputs

RECORD = "origin string, retained boolean, ordinal long, agent string, session string, native_session string, native_input string, source string, at_ms long, kind string, quality string, reasons array<string>, by_whom string, evidence string, controller string"


def fold(records):
    """The merge of one input's observations, one after the other."""
    never = 2**63
    order = lambda r: (never if r["at_ms"] is None else r["at_ms"], r["session"], r["native_session"], r["source"], r["ordinal"])
    me = lambda r: (r["agent"], r["session"], r["native_session"], r["native_input"])
    old, new = [r for r in records if r["retained"]], sorted((r for r in records if not r["retained"]), key=lambda r: r["ordinal"])
    held = sorted((r for r in old if r["kind"] != "replay"), key=order) or sorted(old, key=order) or sorted(new, key=order)
    owner = held[0]
    out = dict(([r for r in new if me(r) == me(owner)] or [owner])[-1])
    codes = set(out["reasons"])
    if any(me(r) != me(owner) and None not in (r["at_ms"], owner["at_ms"]) and r["at_ms"] != owner["at_ms"] for r in records):
        out["kind"], out["quality"] = "unknown", "partial"
        codes.add("input-kind-unknown")
    sticky, whos, by = any(r["evidence"] == "conflict" for r in records), {r["by_whom"] for r in records} - {"unknown"}, {r["controller"] for r in records} - {None}
    out["controller"] = next(iter(by)) if len(by) == 1 and not sticky else None
    if sticky or len(whos) > 1:
        out["by_whom"], out["evidence"] = "unknown", "conflict"
        codes.add("input-origin-conflict")
    elif whos:
        out["by_whom"] = next(iter(whos))
        out["evidence"] = "source" if any(r["evidence"] == "source" and r["by_whom"] in whos for r in records) else "provenance"
    else:
        out["by_whom"], out["evidence"] = "unknown", "none"
    return out["session"], out["at_ms"], out["kind"], out["quality"], sorted(codes), out["by_whom"], out["evidence"], out["controller"]


def test_merge_in_any_order(spark):
    rng = random.Random(7)
    names = [f.split()[0] for f in RECORD.split(", ")]
    rows, want = [], {}
    for case in range(150):
        made = []
        for k in range(rng.randint(1, 5)):
            who = rng.choice(("human", "automated", "unknown", "unknown"))
            ev = rng.choice(("source", "provenance")) if who != "unknown" else rng.choice(("none", "none", "none", "conflict"))
            s = rng.choice("ab")
            made.append((f"o{case}", k < rng.randint(0, 2), k, "omp", s, s, "i", rng.choice("xy"), rng.choice((None, 5, 5, 6)), rng.choice(("submission", "replay", "unknown")), "recorded", [], who, ev, rng.choice((None, None, "c", "d"))))
        want[f"o{case}"] = fold([dict(zip(names, r)) for r in made])
        rows += made
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        out = merge.merged(spark.createDataFrame(rows, RECORD).repartition(seed + 1)).collect()
        assert {r.origin: (r.session, r.at_ms, r.kind, r.quality, list(r.reasons), r.by_whom, r.evidence, r.controller) for r in out} == want


# ---- claims


def test_strict_feed(spark):
    good = {"version": 1, "agent": "omp", "sessionId": "s", "inputId": "i", "status": "delivered", "origin": "human"}
    bad = [good | {"version": 2}, good | {"version": "1"}, good | {"agent": "x"}, good | {"sessionId": ""}, good | {"inputId": 5}, good | {"status": "sent"}, good | {"origin": "unknown"}, good | {"controller": ""}, good | {"controller": "c" * 129}, good | {"controller": None}, good | {"more": 1}, {k: v for k, v in good.items() if k != "status"}, [good], "x"]
    lines = [json.dumps(x) for x in (good, good | {"controller": "c" * 128}, *bad)] + ["{", "NaN"]
    out = claims.parsed(spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "n int, line string")).orderBy("n").collect()
    assert [r.gap for r in out] == [None, None] + ["unsupported-schema"] * len(bad) + ["parse-gap"] * 2
    assert tuple(out[1].claim) == ("omp", "s", "i", "human", "c" * 128) and out[0].claim.controller is None


INPUT = "origin string, agent string, native_session string, native_input string, at_ms long, kind string, by_whom string, evidence string, controller string, reasons array<string>"


def settle(spark, inputs, said, native=(), cutoff=100):
    i = spark.createDataFrame([(o, "omp", "s", n, at, kind, *rest) for o, n, at, kind, *rest in inputs], INPUT)
    c = spark.createDataFrame([("omp", "s", n, who, by) for n, who, by in said], "agent string, native_session string, native_input string, by_whom string, controller string")
    n = spark.createDataFrame(list(native), "origin string, native_by_whom string, native_evidence string, native_controller string")
    return {r.origin: (r.claim, r.by_whom, r.evidence, r.controller, r.reasons) for r in claims.reconciled(i, n, claims.retained(None, c), cutoff).collect()}


def test_claims_before_and_after_their_input(spark):
    fresh = ("unknown", "none", None, [])
    assert settle(spark, [("a", "1", 5, "submission", *fresh)], [("2", "human", "c")])["a"] == (None, *fresh)
    assert settle(spark, [("a", "1", 5, "submission", *fresh)], [("1", "human", "c"), ("1", "human", "c")])["a"] == ("settled", "human", "provenance", "c", [])
    assert settle(spark, [("a", "1", 500, "submission", *fresh)], [("1", "human", "c")])["a"] == ("pending", *fresh)
    assert settle(spark, [("a", "1", 5, "submission", *fresh), ("b", "1", 5, "context", *fresh)], [("1", "human", None)]) == {"a": ("settled", "human", "provenance", None, []), "b": ("settled", *fresh)}


def test_claims_are_withdrawn_when_their_key_is_shared(spark):
    was = ("human", "provenance", "c", [])
    out = settle(spark, [("a", "1", 5, "submission", *was), ("b", "1", 6, "submission", "unknown", "none", None, [])], [("1", "human", "c")])
    assert out["a"] == ("ambiguous", "unknown", "none", None, []) and out["b"][0] == "ambiguous"
    out = settle(spark, [("a", "1", 5, "context", *was)], [("1", "human", "c")], [("a", "automated", "source", "n")])
    assert out["a"] == ("pending", "automated", "source", "n", [])


def test_conflicts_of_claims_stay(spark):
    fresh, clash = ("unknown", "none", None, []), ("unknown", "conflict", None, ["input-origin-conflict"])
    assert settle(spark, [("a", "1", 5, "submission", *fresh)], [("1", "human", None), ("1", "automated", None)])["a"] == ("settled", *clash)
    assert settle(spark, [("a", "1", 500, "submission", *clash)], [("1", "human", None), ("1", "automated", None)])["a"] == ("pending", *clash)
    assert settle(spark, [("a", "1", 5, "submission", *fresh)], [("1", "human", "c")], [("a", "automated", "source", None)])["a"] == ("settled", "unknown", "conflict", "c", ["input-origin-conflict"])
    assert settle(spark, [("a", "1", 5, "submission", *clash)], [("1", "human", None)])["a"] == ("settled", *clash)
    assert settle(spark, [("a", "1", 5, "submission", *clash)], [("1", "human", None)], [("a", "human", "source", None)])["a"] == ("settled", "human", "source", None, [])


# ---- fork families

FILES = "path string, session string, previous array<string>, header_ms long"


def grouped(spark, rows):
    files = spark.createDataFrame(rows, FILES)
    found = forks.families(files, lineage.families)
    first = forks.canonical(files, found)
    return files, found, first, {r.path: r.owner for r in found.join(first.select("family", F.col("path").alias("owner")), "family").collect()}


def test_four_kinds_of_edges(spark):
    rows = [
        ("/a.jsonl", "1", [], 20), ("/b.jsonl", "1", [], 10), ("/c.jsonl", "3", ["/a.jsonl"], None), ("/d.jsonl", "4", ["/gone.jsonl"], 5), ("/e.jsonl", "5", ["/gone.jsonl"], 5), ("/alone.jsonl", "6", [], 1),
        ("/a/kid.jsonl", "7", [], 1), ("/b/kid.jsonl", "8", [], 2), ("/d/kid.jsonl", "9", [], 3), ("/a/kid/deep.jsonl", "10", [], 9), ("/b/kid/deep.jsonl", "11", [], 8), ("/a/other.jsonl", "12", [], 1), ("/ax.jsonl", "13", [], 1),
    ]
    *_, owner = grouped(spark, rows)
    groups = {}
    for path, first in owner.items():
        groups.setdefault(first, set()).add(path)
    assert groups == {
        "/b.jsonl": {"/a.jsonl", "/b.jsonl", "/c.jsonl"}, "/d.jsonl": {"/d.jsonl", "/e.jsonl"}, "/alone.jsonl": {"/alone.jsonl"}, "/a/kid.jsonl": {"/a/kid.jsonl", "/b/kid.jsonl"}, "/d/kid.jsonl": {"/d/kid.jsonl"},
        "/b/kid/deep.jsonl": {"/a/kid/deep.jsonl", "/b/kid/deep.jsonl"}, "/a/other.jsonl": {"/a/other.jsonl"}, "/ax.jsonl": {"/ax.jsonl"},
    }


def test_replays_and_usage_of_a_family(spark):
    _, found, first, _ = grouped(spark, [("/a.jsonl", "1", [], 10), ("/b.jsonl", "2", ["/a.jsonl"], 20), ("/x.jsonl", "3", [], 1)])
    inputs = spark.createDataFrame([("/a.jsonl", "1", "i", 5, "unknown", "partial", ["input-kind-unknown"]), ("/b.jsonl", "2", "i", 1, "submission", "recorded", []), ("/b.jsonl", "2", "j", 7, "context", "recorded", []), ("/x.jsonl", "3", "i", 5, "submission", "recorded", [])], "path string, session string, native_input string, at_ms long, kind string, quality string, reasons array<string>")
    assert {(r.path, r.native_input): r.kind for r in forks.marked(inputs, found, first).collect()} == {("/a.jsonl", "i"): "unknown", ("/b.jsonl", "i"): "replay", ("/b.jsonl", "j"): "context", ("/x.jsonl", "i"): "submission"}
    usage = "path string, line long, kind string, response string, entry string, at_ms long, provider string, model string, uncached long, cache_read long, cache_write long, output long, reasoning long, total long, quality string, reasons array<string>"
    row = lambda path, line, kind, response, entry, at, *counts: (path, line, kind, response, entry, at, "p", "m", *counts, "recorded", [])
    rows = [
        row("/b.jsonl", 1, "message", "r", None, 1, 5, 0, 0, 5, 0, 10), row("/a.jsonl", 9, "model_usage", "r", None, 1, 5, 0, 0, 5, 0, 10), row("/a.jsonl", 10, "message", "r", None, 2, 5, 0, 0, 5, 0, 10), row("/x.jsonl", 1, "message", "r", None, 1, 5, 0, 0, 5, 0, 10),
        row("/a.jsonl", 1, "message", None, "e", 1, 1, 0, 0, 1, None, 2), row("/b.jsonl", 2, "message", None, "e", 1, 2, 0, 0, 1, 0, 3), row("/x.jsonl", 2, "message", None, "e", 1, 7, 0, 0, 1, 0, 8),
        row("/a.jsonl", 3, "message", None, "f", 1, 1, 0, 0, 1, 0, 2), row("/b.jsonl", 3, "message", None, "f", 2, 1, 0, 0, 1, 0, 2), row("/a.jsonl", 4, "message", None, None, 1, 1, 0, 0, 1, 0, 2), row("/b.jsonl", 4, "message", None, None, 1, 1, 0, 0, 1, 0, 2),
    ]
    out = {(r.path, r.line): (r.quality, r.excluded) for r in forks.selected(spark.createDataFrame(rows, usage), found, first).collect()}
    assert out in ({("/a.jsonl", 10): ("recorded", 0), ("/a.jsonl", 1): ("partial", 1), ("/x.jsonl", 2): ("recorded", 0), ("/a.jsonl", 3): ("partial", 1), ("/a.jsonl", 4): ("recorded", 0)}, {("/x.jsonl", 1): ("recorded", 0), ("/a.jsonl", 1): ("partial", 1), ("/x.jsonl", 2): ("recorded", 0), ("/a.jsonl", 3): ("partial", 1), ("/a.jsonl", 4): ("recorded", 0)})
