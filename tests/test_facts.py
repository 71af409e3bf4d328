"""Facts by day, scope from real paths, discovery and repositories, over folders made here."""

import glob
import json
import os

from pyspark.sql import functions as F

from tallyspark.plans import facts, state
from tallyspark.sources import discovery, walk

DAY = 86_400_000
ROWS = "origin string, source string, agent string, session string, workspace string, repository string, at_ms long, total long, workspace_key string, repository_key string, decision string, scope_reason string"


def row(origin, at, total=1, workspace="/w", source="s"):
    return (origin, source, "omp", "x", workspace, None, at, total, None, None, "included", "none")


def held(spark, folder):
    return sorted((r.origin, r.at_ms, r.total) for r in facts.read(spark, folder, "usage").collect())


def test_a_merge_writes_only_its_days(spark, tmp_path):
    folder = str(tmp_path / "f")
    merge = lambda rows: sorted(r.day for r in facts.merge(spark, folder, "usage", spark.createDataFrame(rows, ROWS), "origin", "at_ms").collect())
    assert merge([row("a", 5), row("b", DAY), row("c", 2 * DAY), row("n", None)]) == ["1970-01-01", "1970-01-02", "1970-01-03", "undated"]
    still = {d: set(glob.glob(f"{folder}/usage/day={d}/*.parquet")) for d in ("1970-01-02", "undated")}
    assert merge([row("c", 5, 7), row("d", 6)]) == ["1970-01-01", "1970-01-03"]
    assert held(spark, folder) == [("a", 5, 1), ("b", DAY, 1), ("c", 5, 7), ("d", 6, 1), ("n", None, 1)]
    assert {d: set(glob.glob(f"{folder}/usage/day={d}/*.parquet")) for d in still} == still
    assert merge([row("c", 5, 7), row("d", 6)]) == ["1970-01-01"] and len(held(spark, folder)) == 5
    one_day = facts.read(spark, folder, "usage", F.col("day") == "1970-01-02")
    assert [r.origin for r in one_day.collect()] == ["b"] and "PartitionFilters: [isnotnull(day" in one_day._jdf.queryExecution().executedPlan().toString()


def scope(spark, folder, tuples, roots=(), repositories=(), historical=(), cached=(), places=()):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    out = facts.resolved(
        make(tuples, "agent string, session string, workspace string, repository string"), make(places, "path string, live string, common string"), make([(r,) for r in roots], "path string"), make(repositories, "path string, common string"),
        make(historical, "nth int, path string, exact boolean, repository string"), make(cached, "agent string, session string, workspace string, repository string"),
    )
    return out


def test_the_ladder_over_paths(spark, tmp_path):
    t = lambda w, r=None, s="x": ("omp", s, w, r)
    tuples = [t("/live/a"), t("/live/b"), t("/live/a", "/live/b"), t("/root/x/y"), t("/rooted"), t("/old/x/z"), t("/old/exact"), t("/old/exact/no"), t("/lost/x"), t("/gone"), t(None), t("relative"), t("/link"), t("/cached", s="k"), t("/cached", s="other")]
    places = [("/live/a", "/real/a", "/real/a/.git"), ("/live/b", "/real/b", "/real/b/.git"), ("/link", "/root/linked", None)]
    out = scope(spark, tmp_path, tuples, ["/root"], [("/real/a", "/real/a/.git")], [(0, "/old/x", False, "/real/a/sub"), (1, "/old/exact", True, "/root/r"), (2, "/lost", False, "/elsewhere")], [("omp", "k", "/cached", "/real"), ("omp", "other", "/cached", "/elsewhere")], places)
    got = {(r.session, r.workspace, r.repository): (r.workspace_key, r.repository_key, r.decision, r.scope_reason) for r in out.collect()}
    assert len(got) == len(tuples)
    assert got["x", "/live/a", None] == ("/real/a", "/real/a", "included", "repository-identity") and got["x", "/live/b", None] == ("/real/b", None, "out-of-scope", "unrelated-live-repository")
    assert got["x", "/live/a", "/live/b"] == ("/real/a", None, "unattributed", "attribution-conflict")
    assert got["x", "/root/x/y", None] == ("/root/x/y", None, "included", "configured-root") and got["x", "/rooted", None][2:] == ("out-of-scope", "outside-configured-scope") and got["x", "/link", None] == ("/root/linked", None, "included", "configured-root")
    assert got["x", "/old/x/z", None] == ("/old/x/z", "/real/a/sub", "included", "historical-prefix") and got["x", "/old/exact", None][1:] == ("/root/r", "included", "historical-exact") and got["x", "/old/exact/no", None][3] == "outside-configured-scope"
    assert got["x", "/lost/x", None][3] == "outside-configured-scope" and got["k", "/cached", None][1:] == ("/real", "included", "cached-attribution") and got["other", "/cached", None][2] == "out-of-scope"
    assert got["x", None, None] == got["x", "relative", None] == ("unattributed", None, "unattributed", "attribution-unavailable")


def test_scope_shrinks_and_grows_without_losing_facts(spark, tmp_path):
    folder = str(tmp_path / "f")
    states = lambda *s: spark.createDataFrame([(n, q, r, g) for n, q, r, g in s], "source string, quality string, reasons array<string>, good_ms long")
    batch = lambda *rows: {"usage": (spark.createDataFrame(list(rows), ROWS), "origin", "at_ms")}
    tuples = [("omp", "x", "/w", None), ("omp", "x", "/v", None)]
    inside, outside = scope(spark, tmp_path, tuples, ["/w", "/v"]), scope(spark, tmp_path, tuples, ["/v"])
    facts.collect(spark, folder, 1, states(("s", "partial", ["input-kind-unknown"], 100), ("t", "recorded", [], 100)), batch(row("a", 5, 10), row("b", DAY, 3, "/v", "t")), inside)
    kept = set(glob.glob(f"{folder}/usage/day=1970-01-02/*.parquet"))
    lost = states(("s", "unavailable", ["missing-source"], None))
    for number in (2, 3):
        facts.collect(spark, folder, number, lost, batch(row("never", 5, 99)), outside)
        told = {r.origin: (r.decision, r.total) for r in facts.read(spark, folder, "usage").collect()}
        assert told == {"a": ("out-of-scope", 10), "b": ("included", 3)}
        assert {r.source: (r.quality, r.good_ms, r.reasons) for r in state.before(spark, folder, "sources", number + 1).collect()} == {"s": ("unavailable", 100, ["input-kind-unknown", "missing-source"]), "t": ("recorded", 100, [])}
    assert set(glob.glob(f"{folder}/usage/day=1970-01-02/*.parquet")) == kept
    facts.collect(spark, folder, 4, states(("s", "recorded", [], 400)), batch(row("a", 5, 10)), inside)
    assert {r.origin: r.decision for r in facts.read(spark, folder, "usage").collect()} == {"a": "included", "b": "included"}
    assert facts.rescope(spark, folder, "usage", inside).isEmpty()


def test_a_stream_into_facts(spark, tmp_path):
    from tallyspark.streaming import ingest

    src, folder = tmp_path / "in", str(tmp_path / "f")
    src.mkdir()
    f = src / "a.jsonl"
    parse = lambda b: b.select(F.get_json_object("line", "$.k").alias("k"), F.get_json_object("line", "$.at").cast("long").alias("at_ms"), F.get_json_object("line", "$.v").cast("long").alias("v"), "offset")
    run = lambda: ingest.into_facts(spark, str(src), folder, "usage", "k", "offset", "at_ms", parse, str(tmp_path / "ck"))
    told = lambda: {r.k: (r.at_ms, r.v) for r in facts.read(spark, folder, "usage").collect()}
    f.write_text('{"k": "a", "at": 1, "v": 1}\n{"k": "b", "at": 90000000, "v": 2}\n{"k": "a", "at": 2, "v": 3}\n{"k": "c"')
    run()
    assert told() == {"a": (2, 3), "b": (90_000_000, 2)}
    kept = set(glob.glob(f"{folder}/usage/day=1970-01-02/*.parquet"))
    with f.open("a") as x:
        x.write(', "at": null, "v": 9}\n{"k": "a", "at": 7, "v": 5}\n')
    run()
    assert told() == {"a": (7, 5), "b": (90_000_000, 2), "c": (None, 9)} and set(glob.glob(f"{folder}/usage/day=1970-01-02/*.parquet")) == kept


# ---- walks


def put(path, text=""):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_walk_stays_within_its_roots(spark, tmp_path):
    root, out = tmp_path / "root", tmp_path / "out"
    put(f"{root}/a/b/x.jsonl", "z" * 300_000)
    put(f"{root}/y.jsonl", "short")
    put(f"{root}/a/other.txt")
    put(f"{root}/node_modules/p/q.jsonl")
    put(f"{out}/secret.jsonl")
    os.symlink(out, root / "a" / "leak")
    os.symlink(out / "secret.jsonl", root / "a" / "secret.jsonl")
    os.symlink(root / "a", root / "inner")
    got = {os.path.relpath(r.path, root): (r.kind, r.size, None if r.head is None else len(r.head)) for r in walk.files(spark, [str(root), str(root), str(tmp_path / "none")], r"\.jsonl$", 1 << 20, ("node_modules",)).collect()}
    assert got == {"a/b/x.jsonl": ("file", 300_000, walk.HEAD), "y.jsonl": ("file", 5, 5), "a/leak": ("symlink-escape", None, None), "a/secret.jsonl": ("symlink-escape", None, None), "../none": ("unreadable", None, None)}


def test_inventory(spark, tmp_path):
    j = json.dumps
    put(f"{tmp_path}/c/1.jsonl", j({"type": "session_meta", "payload": {"id": "s"}}) + "\n{")
    put(f"{tmp_path}/c/2.jsonl", "junk\n")
    put(f"{tmp_path}/l/p/3.jsonl", "\n" + j({"type": "summary"}) + "\n" + j({"type": "user", "sessionId": "s"}) + "\n")
    put(f"{tmp_path}/o/4.jsonl", j({"type": "title"}) + "\n" + j({"type": "session", "version": 2, "id": "x"}) + "\n")
    put(f"{tmp_path}/home/.kimi-code/bin/kimi")
    put(f"{tmp_path}/home/Library/Application Support/Grok Bot/sand-client-persistence/a.blob")
    out = discovery.inventory(spark, f"{tmp_path}/home", {"codex": [f"{tmp_path}/c"], "claude": [f"{tmp_path}/l"], "omp": [f"{tmp_path}/o"]}).collect()
    assert [r.agent for r in out] == list(discovery.ORDER)
    assert {r.agent: (r.state, r.tokens, r.paths, r.reasons) for r in out} == {
        "codex": ("partial", "partial", 2, ["unsupported-schema"]), "claude": ("available", "recorded", 1, []), "omp": ("unsupported-schema", "unavailable", 1, ["unsupported-schema"]), "opencode": ("not-found", "unavailable", 0, ["missing-source"]),
        "hermes": ("not-found", "unavailable", 0, ["missing-source"]), "kimi": ("installed-no-history", "unavailable", 1, ["parse-gap"]), "grok": ("unsupported-schema", "unavailable", 1, ["unsupported-schema"]),
    }


def test_lineage_of_threads(spark):
    threads = spark.createDataFrame([("a", "/a"), ("b", "/b"), ("c", None), ("a", "/a")], "id string, rollout_path string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("a", "a"), ("a", "b")], "parent_thread_id string, child_thread_id string")
    assert sorted((r.session, r.parent, r.path) for r in discovery.lineage(threads, edges).collect()) == [("a", None, "/a"), ("b", "a", "/b"), ("c", None, None)]


def test_repositories_by_common_folder(spark, tmp_path):
    root = f"{tmp_path}/r"
    put(f"{root}/main/.git/HEAD")
    put(f"{root}/main/.git/worktrees/w/commondir", "../..\n")
    put(f"{root}/aside/.git", f"gitdir: {root}/main/.git/worktrees/w\n")
    put(f"{root}/two/.git/HEAD")
    put(f"{root}/three/.git/HEAD")
    put(f"{root}/broken/.git", "gitdir: /nowhere\n")
    put(f"{root}/build/four/.git/HEAD")
    put(f"{tmp_path}/far/HEAD")
    os.makedirs(f"{root}/linked")
    os.symlink(f"{tmp_path}/far", f"{root}/linked/.git")
    found = walk.files(spark, [root], "$^", 0, walk.PRUNED)
    schema = "path string, remote string, branch string, common string"
    configured = [(f"{root}/two", "up", "main", walk.common_dir(f"{root}/two")), (f"{root}/three", "a", None, walk.common_dir(f"{root}/three")), (f"{root}/three", "b", None, walk.common_dir(f"{root}/three")), (f"{root}/none", "x", None, walk.common_dir(f"{root}/none"))]
    good, bad = discovery.repositories(found, spark.createDataFrame(configured, schema))
    assert sorted((os.path.basename(r.path), r.remote, r.branch, r.worktrees) for r in good.collect()) == [("main", "origin", None, 2), ("two", "up", "main", 1)]
    assert sorted((r.code, os.path.basename(r.path)) for r in bad.collect()) == [("common-dir-unavailable", "broken"), ("common-dir-unavailable", "none"), ("duplicate-config-conflict", "three"), ("symlink-escape", "linked")]
    worktree, _ = discovery.repositories(found, spark.createDataFrame([(f"{root}/aside", "fork", None, walk.common_dir(f"{root}/aside"))], schema))
    assert ("aside", "fork") in {(os.path.basename(r.path), r.remote) for r in worktree.collect()}
    clash, _ = discovery.repositories(found, spark.createDataFrame([(f"{root}/aside", "a", None, walk.common_dir(f"{root}/aside")), (f"{root}/main", "b", None, walk.common_dir(f"{root}/main"))], schema))
    assert {os.path.basename(r.path) for r in clash.collect()} == {"two", "three"}
