"""Further registered queries: scalar fields, filters, source state, incremental writes, lineage, views."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clock, fields, pricing, quality
from ..operators import dedup, intervals, scope, usage
from ..sources import normalise
from . import catalog, store, views
from .catalog import _D, _HOURLY, _LAST, _PRICED, _SPINE, _included, _text, query
from .views import COMMITS_SQL, CUTOFF_MS, EVENTS_SQL, INPUTS_SQL, USAGE_SQL, WORK_SQL, ZONE, local_date_sql, midnight_sql

_NATIVE = f"{EVENTS_SQL}, nv AS (SELECT id, k * 10 AS i, id % 60 AS r, id % 7 AS w, CAST(floor(value) AS BIGINT) AS o, id % 40 AS q, CASE id % 4 WHEN 0 THEN k * 10 + CAST(floor(value) AS BIGINT) WHEN 1 THEN k * 10 + id % 60 + id % 7 + CAST(floor(value) AS BIGINT) WHEN 2 THEN k * 10 + id % 60 + id % 7 + CAST(floor(value) AS BIGINT) + id % 40 END AS t FROM ev)"


def _native(spark, sf) -> DataFrame:
    i, r, w, o, q = F.col("k") * 10, F.col("id") % 60, F.col("id") % 7, F.floor("value").cast("bigint"), F.col("id") % 40
    t = F.when(F.col("id") % 4 == 0, i + o).when(F.col("id") % 4 == 1, i + r + w + o).when(F.col("id") % 4 == 2, i + r + w + o + q)
    return views.events(spark, sf).select("id", i.alias("i"), r.alias("r"), w.alias("w"), o.alias("o"), q.alias("q"), t.alias("t"))


def _normalised(spark, sf, f, *names) -> DataFrame:
    u = _native(spark, sf).withColumn("u", f(*[F.col(n) for n in names]))
    return u.select("id", *[F.col(f"u.{c}").alias(c) for c in ("uncached", "cache_read", "cache_write", "output", "reasoning", "total", "quality")])


def _shape(uncached, output, reasoning, total, good):
    return f"WITH {_NATIVE} SELECT id, {uncached} AS uncached, r AS cache_read, w AS cache_write, {output} AS output, {reasoning} AS reasoning, {total} AS total, CASE WHEN {good} THEN 'recorded' ELSE 'partial' END AS quality FROM nv"


@query(_shape("CASE WHEN i - r - w >= 0 AND i + o = t THEN i - r - w END", "o", "CASE WHEN q <= o THEN q END", "t", "coalesce(i - r - w >= 0 AND i + o = t AND q <= o, false)"))
def p1_usage_inclusive(spark, sf):
    return _normalised(spark, sf, normalise.inclusive_input, *"irwoqt")


@query(_shape("i", "o", "CASE WHEN q <= o THEN q END", "i + r + w + o", "q <= o"))
def p2_usage_disjoint(spark, sf):
    return _normalised(spark, sf, normalise.disjoint, *"irwoq")


@query(_shape("i", "o", "CASE WHEN q <= o THEN q END", "CASE WHEN t IS NULL OR t < i + r + w + o THEN i + r + w + o ELSE t END", "q <= o AND coalesce(t >= i + r + w + o, true)"))
def p3_usage_residual(spark, sf):
    return _normalised(spark, sf, normalise.with_residual, *"irwoqt")


_IN, _OUT_ = "(t IS NULL OR (i + r + w + o = t AND q <= o))", "coalesce(i + r + w + o + q = t, false)"
_O = f"(CASE WHEN {_IN} THEN o WHEN {_OUT_} THEN o + q ELSE o END)"


@query(_shape("i", _O, f"CASE WHEN q <= {_O} THEN q END", "coalesce(t, i + r + w + o)", f"({_IN} OR {_OUT_}) AND q <= {_O}"))
def p4_usage_reasoning(spark, sf):
    return _normalised(spark, sf, normalise.reasoning_resolved, *"irwoqt")


@query(_shape("i", "o", "q", "i + r + w + o", "true"))
def p5_usage_cumulative(spark, sf):
    return _normalised(spark, sf, normalise.cumulative, *"irwoq")


@query(f"WITH {EVENTS_SQL} SELECT id, CASE WHEN value - 100 > 0 THEN CAST(floor((value - 100) * 1000000 + 0.5) AS BIGINT) END AS micro, CASE WHEN id % 4 = 0 THEN 'provider-reported' WHEN id % 4 = 1 AND id % 3 <> 0 THEN 'source-estimate' WHEN id % 4 = 2 THEN 'included' ELSE 'unknown' END AS kind FROM ev")
def p6_cost_normalise(spark, sf):
    e, m = views.events(spark, sf), F.col("id") % 4
    status = F.when(m == 0, "Actual").when(m == 1, "estimated").when(m == 2, "INCLUDED")
    return e.select("id", normalise.micro(F.col("value") - 100).alias("micro"), normalise.cost_kind(status, F.when(F.col("id") % 3 != 0, F.col("value")), F.col("value")).alias("kind"))


@query(f"WITH {EVENTS_SQL} SELECT id, CASE id % 5 WHEN 0 THEN at_ms WHEN 1 THEN at_ms // 1000 * 1000 WHEN 2 THEN NULL ELSE at_ms END AS at_ms, CASE WHEN id % 3 = 0 THEN 'unknown' ELSE event_type END AS label FROM ev")
def p13_instants_and_labels(spark, sf):
    e, m = views.events(spark, sf), F.col("id") % 5
    text = F.when(m == 1, F.date_format(F.timestamp_millis("at_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(m == 2, "not a time")
    ms = F.when(m == 2, -F.col("at_ms")).when(m != 1, F.col("at_ms"))
    label = F.when(F.col("id") % 3 != 0, F.col("event_type")).when(F.col("id") % 2 == 0, "  ")
    return e.select("id", fields.instant(text, ms).alias("at_ms"), fields.labelled(label).alias("label"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'tool' WHEN 1 THEN 'inference' ELSE 'excluded' END AS kind FROM events")
def p12_item_type(spark, sf):
    m = F.col("event_id") % 4
    return views.load(spark, sf, "events").select("event_id", fields.item_type(F.when(m == 0, "command_execution").when(m == 1, "Agent-Message").when(m == 2, F.col("event_type"))).alias("kind"))


@query("SELECT event_id, sha256(length(event_type) || ':' || event_type || ';' || length(user_id::VARCHAR) || ':' || user_id || ';0:;') AS id FROM events")
def p16_joined_id(spark, sf):
    return views.load(spark, sf, "events").select("event_id", fields.joined_id(F.col("event_type"), F.col("user_id"), F.lit(None)).alias("id"))


@query(f"WITH {USAGE_SQL} SELECT origin, array_to_string(list_sort(list_filter(reasons, lambda x: x <> 'unknown-model')), ',') AS work_reasons, array_to_string(list_sort(reasons), ',') AS token_reasons FROM us")
def p18_relevant_reasons(spark, sf):
    text = lambda without: F.array_join(fields.relevant(F.concat("reasons", F.array(F.lit("made-up"))), without), ",")
    return views.usage(spark, sf).select("origin", text(fields.ACCOUNTING).alias("work_reasons"), text(fields.TIMING).alias("token_reasons"))


@query(f"WITH {USAGE_SQL} SELECT origin, CAST(CASE quality WHEN 'recorded' THEN 100 WHEN 'partial' THEN 50 ELSE 0 END + {' + '.join(f'CAST({c} IS NOT NULL AS INTEGER)' for c in dedup.COUNTED)} AS INTEGER) AS score FROM us")
def p21_completeness(spark, sf):
    return views.usage(spark, sf).select("origin", dedup.completeness().alias("score"))


@query(f"WITH {EVENTS_SQL}, l AS (SELECT id, timezone('{ZONE}', timezone('UTC', make_timestamp(at_ms * 1000))) AS t FROM ev) SELECT id, CAST(dayofweek(t) AS INTEGER) AS sunday_0, CAST(isodow(t) AS INTEGER) AS monday_1, CAST(hour(t) AS INTEGER) AS hour, CAST(CAST(t AS DATE) AS VARCHAR) AS date FROM l")
def p24_weekdays(spark, sf):
    t = F.from_utc_timestamp(F.timestamp_millis("at_ms"), ZONE)
    return views.events(spark, sf).select("id", (F.dayofweek(t) - 1).alias("sunday_0"), (F.weekday(t) + 1).alias("monday_1"), F.hour(t).alias("hour"), clock.local_date("at_ms", ZONE).cast("string").alias("date"))


_PATHS = "pt AS (SELECT DISTINCT '/w/' || event_type || CASE WHEN user_id % 3 = 0 THEN '-x' ELSE '/' || user_id END AS p FROM events), rt AS (SELECT unnest(['/w/view', '/w/click/', '/w/error/1']) AS root)"


@query(f"WITH {_PATHS} SELECT p, root FROM pt JOIN rt ON p = root OR starts_with(p, rtrim(root, '/') || '/')")
def p27_path_containment(spark, sf):
    e = views.load(spark, sf, "events")
    paths = e.select(F.concat(F.lit("/w/"), "event_type", F.when(F.col("user_id") % 3 == 0, "-x").otherwise(F.concat(F.lit("/"), "user_id"))).alias("p")).distinct()
    roots = spark.createDataFrame([("/w/view",), ("/w/click/",), ("/w/error/1",)], "root string")  # configured, a handful
    return paths.join(F.broadcast(roots), scope.within(F.col("p"), F.col("root")))


_CUT = 1_705_000_000_000


@query(f"WITH {INPUTS_SQL} SELECT agent, count(*) FILTER (at_ms IS NULL OR at_ms <= {_CUT}) AS up_to_cutoff, count(*) FILTER (at_ms IS NULL OR at_ms BETWEEN {_CUT} - 604800000 AND {_CUT}) AS in_window, bool_or(at_ms = (SELECT max(at_ms) FROM inp)) AS has_last FROM inp GROUP BY agent")
def f1_cutoff_filters(spark, sf):
    i = views.inputs(spark, sf)
    last = i.agg(F.max("at_ms").alias("last"))  # one row
    at = F.col("at_ms")
    return i.crossJoin(F.broadcast(last)).groupBy("agent").agg(F.count_if(at.isNull() | (at <= _CUT)).alias("up_to_cutoff"), F.count_if(at.isNull() | at.between(_CUT - 604_800_000, _CUT)).alias("in_window"), F.bool_or(at == F.col("last")).alias("has_last"))


_BIN = f"({_CUT} // 3600000 * 3600000)"


@query(f"WITH {WORK_SQL} SELECT origin, greatest(start_ms, {_BIN} - 86400000) AS start_ms, least(end_ms, {_BIN}) AS end_ms FROM wk WHERE end_ms > {_BIN} - 86400000 AND start_ms < {_BIN}")
def i1_clip(spark, sf):
    to = _CUT // clock.HOUR * clock.HOUR
    return intervals.clip(views.work(spark, sf), F.lit(to - 86_400_000), F.lit(to)).select("origin", "start_ms", "end_ms")


@query(_HOURLY + f", cut AS (SELECT days, date FROM (SELECT unnest([7, 30]) AS days) r JOIN (SELECT DISTINCT date FROM sl) d ON CAST(date AS DATE) > {_LAST} - CAST(days AS INTEGER)) SELECT days, count(*) AS slots, CAST(sum(active_ms) AS BIGINT) AS active_ms, CAST(sum(agent_ms) AS BIGINT) AS agent_ms, CAST(sum(CASE WHEN active_ms IS NULL THEN slot_end - slot_start END) AS BIGINT) AS unavailable_ms FROM hr JOIN cut USING (date) GROUP BY days")
def a13_combined_ranges(spark, sf):
    ranges = spark.createDataFrame([(7,), (30,)], "days int")
    last = clock.local_date(F.lit(CUTOFF_MS), ZONE)
    h = catalog._hourly(spark, sf).join(F.broadcast(ranges), F.to_date("date") > F.date_sub(last, F.col("days")))
    return h.groupBy("days").agg(F.count("*").alias("slots"), F.sum("active_ms").alias("active_ms"), F.sum("agent_ms").alias("agent_ms"), F.sum(F.when(F.col("active_ms").isNull(), F.col("slot_end") - F.col("slot_start"))).alias("unavailable_ms"))


_SRC = f"{EVENTS_SQL}, sr AS (SELECT agent, session, max(at_ms) AS seen_ms, max(at_ms) FILTER (event_type <> 'error' AND id % 4 <> 0) AS good_ms, count(*) FILTER (id % 10 = 0) AS gaps, CASE WHEN session % 9 = 0 THEN 'unavailable' WHEN session % 4 = 0 THEN 'partial' ELSE 'recorded' END AS quality FROM ev GROUP BY ALL)"


def _sources(spark, sf) -> DataFrame:
    good = F.max(F.when((F.col("event_type") != "error") & (F.col("id") % 4 != 0), F.col("at_ms")))
    q = F.when(F.col("session") % 9 == 0, "unavailable").when(F.col("session") % 4 == 0, "partial").otherwise("recorded")
    return views.events(spark, sf).groupBy("agent", "session").agg(F.max("at_ms").alias("seen_ms"), good.alias("good_ms"), F.count_if(F.col("id") % 10 == 0).alias("gaps")).withColumn("quality", q)


@query(f"WITH {_SRC} SELECT agent, CASE WHEN count(*) FILTER (quality = 'unavailable') = count(*) THEN 'unavailable' WHEN count(*) FILTER (quality = 'recorded') = count(*) THEN 'recorded' ELSE 'partial' END AS quality, count(DISTINCT quality) AS states, bool_or(good_ms IS NULL) AS never_read, max(seen_ms) AS last_seen_ms, max(coalesce(good_ms, seen_ms)) AS last_scan_ms, CAST(sum(CASE WHEN seen_ms > good_ms THEN 1 ELSE 0 END) AS BIGINT) AS stale FROM sr GROUP BY agent")
def a19_source_state(spark, sf):
    return _sources(spark, sf).groupBy("agent").agg(
        quality.combined("quality").alias("quality"), F.count_distinct("quality").alias("states"), F.bool_or(F.col("good_ms").isNull()).alias("never_read"), F.max("seen_ms").alias("last_seen_ms"),
        F.max(F.coalesce("good_ms", "seen_ms")).alias("last_scan_ms"), F.coalesce(F.sum(F.when(F.col("seen_ms") > F.col("good_ms"), 1).otherwise(0)), F.lit(0)).alias("stale"),
    )


@query(f"WITH {EVENTS_SQL} SELECT agent, string_agg(event_type || '-' || p || '=' || n, ',' ORDER BY event_type || '-' || p) AS counts FROM (SELECT agent, event_type, CAST(id % 3 AS VARCHAR) AS p, count(*) AS n FROM ev GROUP BY ALL) GROUP BY agent")
def a22_diagnostics(spark, sf):
    per = views.events(spark, sf).select("agent", F.create_map(F.concat("event_type", F.lit("-"), (F.col("id") % 3).cast("string")), F.lit(1)).alias("m"))
    each = per.select("agent", F.explode("m").alias("name", "n")).groupBy("agent", "name").agg(F.sum("n").alias("n"))
    return each.groupBy("agent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "n"))), lambda x: F.concat_ws("=", x["name"], x["n"])), ",").alias("counts"))


@query(f"WITH {USAGE_SQL}, dy AS (SELECT {_D} AS d, agent, sum(total) AS v, bool_and(total IS NOT NULL AND quality = 'recorded') AS whole FROM us WHERE decision = 'included' GROUP BY ALL) SELECT agent, CAST(sum(v) AS BIGINT) AS tokens, CASE WHEN bool_and(whole AND v IS NOT NULL) THEN 'recorded' WHEN count(v) = 0 THEN 'unavailable' ELSE 'partial' END AS status FROM dy GROUP BY agent")
def a23_reaggregated(spark, sf):
    days = _included(spark, sf).groupBy("date", "agent").agg(*quality.known_sum("total", "v"))
    return days.groupBy("agent").agg(F.sum("v").alias("tokens"), F.when(F.bool_and(F.col("v_status") == "recorded"), "recorded").when(F.count("v") == 0, "unavailable").otherwise("partial").alias("status"))


_LADDER = f"{EVENTS_SQL}, ss AS (SELECT DISTINCT session AS id, session // 3 AS parent FROM ev), fx AS (SELECT id, CASE WHEN id % 13 = 0 THEN 2 ELSE 1 END AS ids, id % 5 = 0 AS inc, id % 7 = 0 AS kn, id % 4 = 0 AS rt, id % 6 = 0 AS hi, id % 9 = 0 AS ca, CASE WHEN id % 2 = 0 THEN '/w' END AS path FROM ss)"


@query(f"WITH {_LADDER} SELECT id, CASE WHEN ids > 1 THEN 'unattributed' WHEN inc THEN 'included' WHEN kn THEN 'out-of-scope' WHEN rt OR hi OR ca THEN 'included' WHEN path IS NULL THEN 'unattributed' ELSE 'out-of-scope' END AS decision, CASE WHEN ids > 1 THEN 'attribution-conflict' WHEN inc THEN 'repository-identity' WHEN kn THEN 'unrelated-live-repository' WHEN rt THEN 'configured-root' WHEN hi THEN 'historical-attribution' WHEN ca THEN 'cached-attribution' WHEN path IS NULL THEN 'attribution-unavailable' ELSE 'outside-configured-scope' END AS scope_reason FROM fx")
def c1_scope_ladder(spark, sf):
    return _scoped(spark, sf).select("id", "decision", "scope_reason")


def _scoped(spark, sf) -> DataFrame:
    ident = F.col("id")
    s = views.events(spark, sf).select(F.col("session").alias("id")).distinct()
    flags = {"live_included": 5, "live_known": 7, "in_root": 4, "historical": 6, "cached": 9}
    s = s.withColumns({"identities": F.when(ident % 13 == 0, 2).otherwise(1), "path": F.when(ident % 2 == 0, "/w")} | {n: ident % m == 0 for n, m in flags.items()})
    return scope.decided(s)


@query(f"WITH {USAGE_SQL}, old AS (SELECT origin, total, session FROM us WHERE origin % 3 <> 0), bt AS (SELECT origin, coalesce(total, 0) + 1 AS total, session + 1000 AS session FROM us WHERE origin % 2 = 0) SELECT * FROM bt UNION ALL SELECT * FROM old WHERE origin NOT IN (SELECT origin FROM bt)")
def k1_keyed_upsert(spark, sf):
    u = views.usage(spark, sf).select("origin", "total", "session")
    batch = u.filter("origin % 2 = 0").select("origin", (F.coalesce("total", F.lit(0)) + 1).alias("total"), (F.col("session") + 1000).alias("session"))
    return store.upserted(u.filter("origin % 3 <> 0"), batch, ["origin"])


@query(f"WITH {COMMITS_SQL}, bt AS (SELECT repository, oid + 1 AS oid, committer_ms FROM cm WHERE repository < 4) SELECT repository, count(*) AS commits, CAST(sum(oid) AS BIGINT) AS oids FROM (SELECT * FROM bt UNION ALL SELECT * FROM cm WHERE repository NOT IN (SELECT repository FROM bt)) GROUP BY repository")
def k3_membership_replacement(spark, sf):
    c = views.commits(spark, sf)
    now = store.replaced(c, c.filter("repository < 4").withColumn("oid", F.col("oid") + 1), "repository")
    return now.groupBy("repository").agg(F.count("*").alias("commits"), F.sum("oid").alias("oids"))


@query(f"WITH {USAGE_SQL}, old AS (SELECT origin, at_ms, session FROM us WHERE origin % 3 <> 0), nw AS (SELECT origin, at_ms + CASE WHEN origin % 2 = 0 THEN 5 ELSE -5 END AS at_ms, session + 1 AS session FROM us) SELECT nw.origin, least(coalesce(old.at_ms, nw.at_ms), nw.at_ms) AS first_ms, coalesce(old.session, nw.session) AS owner FROM nw LEFT JOIN old USING (origin)")
def m6_sticky_first(spark, sf):
    u = views.usage(spark, sf).select("origin", "at_ms", "session")
    old = u.filter("origin % 3 <> 0").select("origin", F.col("at_ms").alias("was_ms"), F.col("session").alias("was"))
    new = u.select("origin", (F.col("at_ms") + F.when(F.col("origin") % 2 == 0, 5).otherwise(-5)).alias("at_ms"), (F.col("session") + 1).alias("session"))
    return new.join(old, "origin", "left").select("origin", F.least("at_ms", F.coalesce("was_ms", "at_ms")).alias("first_ms"), F.coalesce("was", "session").alias("owner"))


@query(f"WITH {USAGE_SQL} SELECT agent, CAST(sum(CAST('0x' || substr(md5(origin || '|' || coalesce(CAST(total AS VARCHAR), '-')), 1, 12) AS BIGINT)) AS VARCHAR) AS fingerprint FROM us GROUP BY agent")
def m9_fingerprint(spark, sf):
    """A print of each agent's facts: a sum of row prints, which meets in partial sums and takes rows in any order."""
    row = F.md5(F.concat_ws("|", "origin", F.coalesce(F.col("total").cast("string"), F.lit("-"))).cast("binary"))
    one = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(20,0)")
    return views.usage(spark, sf).groupBy("agent").agg(F.sum(one).cast("string").alias("fingerprint"))


_VERSION, _RATED = 1, json.dumps(pricing.RATES, separators=(",", ":"))


@query(f"""WITH {USAGE_SQL}, {COMMITS_SQL}, {_SRC[len(EVENTS_SQL) + 2:]}, st AS (
  SELECT string_agg(agent || '|' || quality || '|' || n || '|' || scanned, ',' ORDER BY agent, quality, scanned) AS states FROM (
    SELECT agent, quality, CAST(good_ms IS NOT NULL AS VARCHAR) AS scanned, count(*) AS n FROM sr GROUP BY ALL)),
fu AS (SELECT CAST(min({_D}) AS VARCHAR) AS first FROM us), sh AS (SELECT CAST(bool_or(repository % 5 = 0 AND committer_ms <= {CUTOFF_MS}) AS VARCHAR) AS shallow FROM cm)
SELECT states, first, shallow, sha256(concat_ws(';', '{_VERSION}', '{",".join(views.AGENTS)}', states, first, shallow, '{_RATED}')) AS version FROM st, fu, sh""")
def m9_rollup_version(spark, sf):
    """The version of rollups: agents, states of all sources, earliest date, shallow history and prices, hashed."""
    return rollup_version(_sources(spark, sf), views.usage(spark, sf), views.commits(spark, sf).withColumn("shallow", F.col("repository") % 5 == 0))


def rollup_version(sources: DataFrame, facts: DataFrame, history: DataFrame) -> DataFrame:
    # Sources are counted by state before they are listed, so a task gets a few rows an agent.
    kinds = sources.groupBy("agent", "quality", F.col("good_ms").isNotNull().cast("string").alias("scanned")).agg(F.count("*").alias("n"))
    told = F.transform(F.array_sort(F.collect_list(F.struct("agent", "quality", "scanned", "n"))), lambda x: F.concat_ws("|", x["agent"], x["quality"], x["n"].cast("string"), x["scanned"]))
    states = kinds.agg(F.array_join(told, ",").alias("states"))
    first = facts.agg(F.min(clock.local_date("at_ms", ZONE)).cast("string").alias("first"))
    shallow = history.agg(F.bool_or(F.col("shallow") & (F.col("committer_ms") <= CUTOFF_MS)).cast("string").alias("shallow"))
    one = states.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(shallow))  # one row each
    parts = [F.lit(str(_VERSION)), F.lit(",".join(views.AGENTS)), F.col("states"), F.col("first"), F.col("shallow"), F.lit(_RATED)]
    return one.withColumn("version", F.sha2(F.concat_ws(";", *parts).cast("binary"), 256))


@query(f"WITH {INPUTS_SQL}, g AS (SELECT origin // 4 AS key, origin, at_ms, kind, session FROM inp) SELECT key, CASE WHEN count(DISTINCT at_ms) > 1 OR bool_or(kind = 'unknown') THEN 'unknown' ELSE max(kind) END AS kind, arg_min(session, origin) AS owner, count(*) AS copies FROM g GROUP BY key")
def d9_platform_inputs(spark, sf):
    g = views.inputs(spark, sf).withColumn("key", F.expr("origin div 4"))
    clash = (F.count_distinct("at_ms") > 1) | F.bool_or(F.col("kind") == "unknown")
    return g.groupBy("key").agg(F.when(clash, "unknown").otherwise(F.max("kind")).alias("kind"), F.min_by("session", "origin").alias("owner"), F.count("*").alias("copies"))


@query(f"WITH {EVENTS_SQL} SELECT agent, max(at_ms) AS completed_ms, arg_max(id, (at_ms, id)) AS run FROM ev WHERE at_ms <= {_CUT} GROUP BY agent")
def d10_latest_run(spark, sf):
    e = views.events(spark, sf).filter(F.col("at_ms") <= _CUT)
    return e.groupBy("agent").agg(F.max("at_ms").alias("completed_ms"), F.max_by("id", F.struct("at_ms", "id")).alias("run"))


@query(f"WITH {EVENTS_SQL} SELECT session % 40 AS common_dir, min(session) AS repository, count(DISTINCT session) AS worktrees FROM ev GROUP BY 1")
def d12_worktrees(spark, sf):
    return views.events(spark, sf).groupBy((F.col("session") % 40).alias("common_dir")).agg(F.min("session").alias("repository"), F.count_distinct("session").alias("worktrees"))


@query("SELECT DISTINCT sha256(length(event_type) || ':' || event_type || ';' || length(CAST(user_id AS VARCHAR)) || ':' || user_id || ';') AS claim FROM events")
def d13_claims(spark, sf):
    return views.load(spark, sf, "events").select(fields.joined_id(F.col("event_type"), F.col("user_id")).alias("claim")).distinct()


@query(f"WITH {COMMITS_SQL} SELECT repository, CASE WHEN repository % 5 = 0 THEN CASE WHEN count(*) > 0 THEN 'partial' END ELSE 'recorded' END AS quality, count(*) AS commits FROM cm GROUP BY repository")
def q5_commit_evidence(spark, sf):
    c = views.commits(spark, sf).groupBy("repository").agg(F.count("*").alias("commits"))
    return c.withColumn("quality", quality.degraded(F.lit("recorded"), F.when(F.col("repository") % 5 == 0, "unavailable").otherwise("recorded")))


@query(f"WITH {catalog._END}, rg AS (SELECT unnest([7, 30, 90, 365]) AS days) SELECT days, {midnight_sql('l - CAST(days - 1 AS INTEGER)')} AS from_ms, c AS to_ms FROM rg, ct")
def t4_range_starts(spark, sf):
    cutoff = catalog._cutoff(spark, sf)
    return catalog._ranges(spark, cutoff)


@query(f"WITH {WORK_SQL} SELECT origin, {local_date_sql('start_ms')} = {local_date_sql('end_ms')} AS same_day, CAST(CAST(DATE '1970-01-01' + CAST(start_ms // 86400000 AS INTEGER) AS DATE) AS VARCHAR) AS utc_day FROM wk")
def t5_reporting_dates(spark, sf):
    return views.work(spark, sf).select("origin", (clock.local_date("start_ms", ZONE) == clock.local_date("end_ms", ZONE)).alias("same_day"), F.date_from_unix_date(F.expr("cast(start_ms div 86400000 as int)")).cast("string").alias("utc_day"))


@query(f"WITH {USAGE_SQL} SELECT agent, CAST(list_position({views._list(views.AGENTS)}, agent) AS INTEGER) AS place FROM (SELECT DISTINCT agent FROM us WHERE decision = 'included')")
def v14_harnesses(spark, sf):
    order = F.array(*map(F.lit, views.AGENTS))
    return _included(spark, sf).select("agent").distinct().select("agent", F.array_position(order, F.col("agent")).cast("int").alias("place")).orderBy("place")


@query(f"WITH {_PRICED} SELECT agent, CAST({_D} AS VARCHAR) AS date, {catalog._COST} FROM pr WHERE decision = 'included' GROUP BY ALL HAVING count(*) > 0")
def v11_cost_by_day(spark, sf):
    return usage.priced_cost(_included(spark, sf), "agent", "date")


@query(f"WITH {USAGE_SQL}, {_SPINE}, g AS (SELECT CAST({_D} AS VARCHAR) AS date, sum(total) AS t FROM us WHERE decision = 'included' GROUP BY 1), j AS (SELECT CAST(d AS VARCHAR) AS date, t FROM sp LEFT JOIN g ON g.date = CAST(sp.d AS VARCHAR)) SELECT date, round(coalesce(t, 0) * 1.0 / max(t) OVER (), 6) AS intensity FROM j")
def w9_intensity(spark, sf):
    d = _text(clock.spine(spark, CUTOFF_MS, ZONE, 365), "date").select("date").join(_included(spark, sf).groupBy("date").agg(F.sum("total").alias("t")), "date", "left")
    top = d.agg(F.max("t").alias("top"))  # one row
    return d.crossJoin(F.broadcast(top)).select("date", F.round(F.coalesce("t", F.lit(0)) * F.lit(1.0) / F.col("top"), 6).alias("intensity"))


_TREE = "WITH RECURSIVE n AS (SELECT DISTINCT user_id AS id, CASE WHEN user_id % 3 <> 0 THEN user_id // 2 END AS parent FROM events)"


@query(_TREE + ", up(id, at_) AS (SELECT id, id FROM n UNION ALL SELECT up.id, p.id FROM up JOIN n c ON c.id = up.at_ JOIN n p ON p.id = c.parent), rt AS (SELECT id, min(at_) AS root FROM up GROUP BY id) SELECT root, min(id) AS canonical, count(*) AS members FROM rt GROUP BY root")
def g2_canonical_members(spark, sf):
    from . import lineage

    ids = views.load(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()
    tree = lineage.roots(ids.select("id", F.when((F.col("id") % 3 != 0) & (F.expr("id div 2") != F.col("id")), F.expr("id div 2")).alias("parent")))
    return tree.groupBy("root").agg(F.min_by("id", F.struct("id")).alias("canonical"), F.count("*").alias("members"))


@query("WITH f AS (SELECT DISTINCT '/s/' || user_id % 10 || '/' || user_id || '/x.json' AS p FROM events), k AS (SELECT DISTINCT '/s/' || user_id % 10 AS d FROM events WHERE user_id % 10 < 5 UNION SELECT DISTINCT '/s/' || user_id % 10 || '/' || user_id FROM events WHERE user_id % 2 = 0) SELECT p, arg_max(d, length(d)) AS owner FROM f JOIN k ON starts_with(p, d || '/') GROUP BY p")
def g4_artifact_owner(spark, sf):
    e = views.load(spark, sf, "events").select("user_id").distinct()
    ten = F.concat(F.lit("/s/"), (F.col("user_id") % 10).cast("string"))
    own = F.concat(ten, F.lit("/"), F.col("user_id").cast("string"))
    known = e.filter("user_id % 10 < 5").select(ten.alias("d")).union(e.filter("user_id % 2 = 0").select(own)).distinct()
    files = e.select(F.concat(own, F.lit("/x.json")).alias("p"))
    parts = F.split("p", "/")
    above = files.select("p", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("d"))
    return above.join(known, "d").groupBy("p").agg(F.max_by("d", F.length("d")).alias("owner"))
