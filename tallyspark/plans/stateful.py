"""Registered queries of what carries state from run to run: counters with epochs, clone ownership, message stores, input merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock, quality
from ..operators import claims, clones, cumulative, forks, intervals, merge, messages
from ..sources import families
from . import views
from .catalog import query
from .views import CUTOFF_MS, EVENTS_SQL, TURNS_SQL, USAGE_SQL, WORK_SQL, ZONE, local_date_sql

HALF_DAY = 43_200_000
_V = cumulative.VALUES


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Readings of counters (session, event type), one for each half day with events; they grow by its events and now and then start anew."""
    e = views.events(spark, sf).withColumn("run", F.expr(f"at_ms div {HALF_DAY}"))
    g = e.groupBy("session", "event_type", "run").agg(F.sum("k").alias("k"), F.sum(F.floor("value").cast("bigint")).alias("o"), F.min("at_ms").alias("low"), F.max("at_ms").alias("high"))
    w = Window.partitionBy("session", "event_type").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    g = g.select("session", "event_type", "run", (F.sum("k").over(w) % 700).alias("uncached"), F.sum("o").over(w).alias("output"), F.min("low").over(w).alias("first_ms"), F.col("high").alias("last_ms"))
    n = F.col("session")
    g = g.select(
        F.concat_ws(":", n, "event_type").alias("counter"), n.cast("string").alias("session"), F.lit("m").alias("model"), F.concat(F.lit("p"), (n % 4).cast("string")).alias("provider"), F.when(n % 9 == 0, "title").otherwise("").alias("task"),
        "first_ms", "last_ms", "uncached", F.when(n % 10 != 0, F.lit(0).cast("bigint")).alias("cache_read"), F.lit(0).cast("bigint").alias("cache_write"), "output", F.expr("output div 3").alias("reasoning"),
        F.when(n % 3 == 0, F.col("output") * 2).alias("cost_micro"), F.when(n % 3 == 0, F.when((n % 2 == 0) | (F.col("run") % 4 > 0), "source-estimate").otherwise("provider-reported")).otherwise("unknown").alias("cost_kind"),
        (n % 10 == 0).alias("partial"), (n % 13 == 0).alias("ambiguous"), (n % 17 == 0).alias("upstream"), (n % 9 == 0).alias("unresolved"), ((F.col("run") + 1) * HALF_DAY).alias("observed_ms"),
    )
    return g.withColumn("total", F.col("uncached") + F.col("cache_read") + F.col("cache_write") + F.col("output"))


_READINGS = f"""{EVENTS_SQL}, g0 AS (SELECT session, event_type, at_ms // {HALF_DAY} AS run, sum(k) AS k, sum(CAST(floor(value) AS BIGINT)) AS o, min(at_ms) AS low, max(at_ms) AS high FROM ev GROUP BY ALL),
g1 AS (SELECT session AS n, event_type, run, CAST(sum(k) OVER w % 700 AS BIGINT) AS uncached, CAST(sum(o) OVER w AS BIGINT) AS output, min(low) OVER w AS first_ms, high AS last_ms FROM g0 WINDOW w AS (PARTITION BY session, event_type ORDER BY run)),
rd0 AS (SELECT n || ':' || event_type AS counter, n, run, first_ms, last_ms, uncached, CASE WHEN n % 10 <> 0 THEN 0::BIGINT END AS cache_read, 0::BIGINT AS cache_write, output, output // 3 AS reasoning, CASE WHEN n % 3 = 0 THEN output * 2 END AS cost_micro,
  CASE WHEN n % 3 <> 0 THEN 'unknown' WHEN n % 2 = 0 OR run % 4 > 0 THEN 'source-estimate' ELSE 'provider-reported' END AS cost_kind, uncached + CASE WHEN n % 10 <> 0 THEN 0::BIGINT END + output AS total FROM g1)"""
_FALL = " OR ".join(f"coalesce({v} < lag({v}) OVER w, false)" for v in _V)
_LAGS = ", ".join(f"lag({v}) OVER w AS was_{v}" for v in _V)
_ADD = ", ".join(f"CASE WHEN opening THEN {v} ELSE {v} - was_{v} END AS add_{v}" for v in _V)
_M3 = f"""WITH {_READINGS}, l AS (SELECT *, row_number() OVER w = 1 AS opening, ({_FALL}) AND n % 17 <> 0 AND n % 9 <> 0 AS fall, lag(last_ms) OVER w AS was_last, lag(cost_kind) OVER w AS was_kind, {_LAGS} FROM rd0 WINDOW w AS (PARTITION BY counter ORDER BY run)),
e AS (SELECT *, CAST(sum(CAST(fall AS INT)) OVER (PARTITION BY counter ORDER BY run) AS INTEGER) AS epoch, CASE WHEN opening THEN first_ms ELSE was_last END AS since, {_ADD} FROM l WHERE n % 17 <> 0),
d AS (SELECT *, {local_date_sql("since")} = {local_date_sql("last_ms")} AS same_day FROM e WHERE NOT fall),
b AS (SELECT *, n % 9 = 0 OR NOT same_day AS undated FROM d)
SELECT counter, CASE WHEN NOT undated THEN last_ms END AS at_ms, epoch, add_uncached AS uncached, add_output AS output, add_reasoning AS reasoning, add_total AS total,
  CASE WHEN opening OR undated OR was_kind = cost_kind THEN add_cost_micro END AS cost_micro,
  CASE WHEN CASE WHEN opening OR undated OR was_kind = cost_kind THEN add_cost_micro END IS NULL THEN 'unknown' ELSE cost_kind END AS cost_kind,
  CASE WHEN n % 10 = 0 OR n % 13 = 0 OR undated THEN 'partial' ELSE 'recorded' END AS quality,
  concat_ws(',', CASE WHEN n % 13 = 0 THEN 'duplicate-ambiguity' END, CASE WHEN n % 10 = 0 THEN 'parse-gap' END, CASE WHEN undated THEN 'unallocated-history' END) AS reasons
FROM b WHERE add_uncached > 0 OR add_output > 0 OR add_reasoning > 0 OR coalesce(add_total > 0, false) OR coalesce(CASE WHEN opening OR undated OR was_kind = cost_kind THEN add_cost_micro END > 0, false)"""


@query(_M3)
def m3_counter_epochs(spark, sf):
    u = cumulative.history(readings(spark, sf), ZONE)
    return u.select("counter", "at_ms", "epoch", "uncached", "output", "reasoning", "total", "cost_micro", "cost_kind", "quality", F.array_join("reasons", ",").alias("reasons"))


# ---- clone ownership


def _sessions(spark, sf) -> DataFrame:
    """Turns of conversations as turns of sessions; of the forks, some began before what they repeat."""
    t = views.turns(spark, sf)
    conv = F.col("conv_id")
    started = F.when(conv >= 1_000_000, conv % 1_000_000 * 10 + F.when(conv % 2 == 0, 5).otherwise(-5)).otherwise(conv * 10)
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.select(conv.alias("session"), pos.alias("pos"), "print", "role", started.alias("started_ms"), (F.col("role") == "assistant").alias("counted"))


_SESSIONS = f"""{TURNS_SQL}, ss AS (SELECT conv_id AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, print, role,
  CASE WHEN conv_id >= 1000000 THEN conv_id % 1000000 * 10 + CASE WHEN conv_id % 2 = 0 THEN 5 ELSE -5 END ELSE conv_id * 10 END AS started_ms FROM tn)"""


def _clones_sql(rows: str, name: str) -> str:
    """D6 over ``rows``: (session, owner, prefix)."""
    return f"""{name}c AS (SELECT session, started_ms, pos, string_agg(print, ',') OVER w AS upto, max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER w AS answered FROM {rows} WINDOW w AS (PARTITION BY session ORDER BY pos)),
{name}o AS (SELECT pos, upto, arg_min(session, (started_ms, session)) AS owner FROM {name}c WHERE pos >= 2 AND answered = 1 GROUP BY ALL HAVING count(*) > 1),
{name} AS (SELECT session, arg_max(owner, pos) AS owner, max(pos) AS prefix FROM {name}c JOIN {name}o USING (pos, upto) WHERE answered = 1 AND session <> owner GROUP BY session)"""


_M4 = f"""{_SESSIONS}, s1 AS (SELECT * FROM ss WHERE session >= 1000000), s2 AS (SELECT * FROM ss WHERE session < 1000000), {_clones_sql('s1', 'd1')},
mem AS (SELECT print, arg_min(coalesce(owner, session), (started_ms, session)) AS owner FROM s1 LEFT JOIN d1 USING (session) WHERE pos <= 32 GROUP BY print),
hd AS (SELECT session, pos, role, started_ms, owner, first(owner ORDER BY pos) OVER w AS f FROM (SELECT s2.*, mem.owner FROM s2 LEFT JOIN mem USING (print) WHERE pos <= 32) WINDOW w AS (PARTITION BY session ORDER BY pos)),
br AS (SELECT *, max(CASE WHEN coalesce(owner = f AND owner <> session, false) THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY pos) AS broken FROM hd),
rc AS (SELECT session, min(owner) AS owner, count(*) AS prefix, min(started_ms) AS started_ms FROM br WHERE broken = 0 GROUP BY session HAVING count(*) >= 2 AND bool_or(role = 'assistant')),
st AS (SELECT DISTINCT session AS owner, started_ms AS owner_ms FROM s1),
told AS (SELECT session, owner, prefix, started_ms < owner_ms OR (started_ms = owner_ms AND session < owner) AS promoted FROM rc JOIN st USING (owner))"""


def _second_run(spark, sf):
    s = _sessions(spark, sf)
    none = spark.createDataFrame([], "print string, owner long")
    first, second = s.filter("session >= 1000000"), s.filter("session < 1000000")
    stored = first.select("session", "started_ms").distinct()
    canonical, _, promoted = clones.owners(first, none, stored.limit(0))
    return second, clones.remembered(first, none, canonical, promoted), stored


@query(f"WITH {_M4} SELECT * FROM told")
def m4_clone_memory(spark, sf):
    return clones.recalled(*_second_run(spark, sf))


@query(f"""WITH {_M4}, up AS (SELECT s2.print, arg_min(s2.session, (s2.started_ms, s2.session)) AS owner FROM s2 JOIN told USING (session) WHERE promoted AND pos <= prefix GROUP BY s2.print), {_clones_sql('s2', 'd2')},
nw AS (SELECT print, arg_min(coalesce(o2, o1, o0, session), (started_ms, session)) AS owner FROM (SELECT s2.*, told.owner AS o1, d2.owner AS o0, NULL::BIGINT AS o2 FROM s2 LEFT JOIN (SELECT * FROM told WHERE NOT promoted) told USING (session) LEFT JOIN d2 USING (session)) WHERE pos <= 32 AND print NOT IN (SELECT print FROM mem) GROUP BY print)
SELECT owner, count(*) AS prints FROM (SELECT print, coalesce(up.owner, mem.owner) AS owner FROM mem LEFT JOIN up USING (print) UNION ALL SELECT print, owner FROM nw) GROUP BY owner""")
def m4_memory_after_run(spark, sf):
    turns, memory, stored = _second_run(spark, sf)
    canonical, _, promoted = clones.owners(turns, memory, stored)
    return clones.remembered(turns, memory, canonical, promoted).groupBy("owner").agg(F.count("*").alias("prints"))


@query(f"""WITH {_SESSIONS}, {_clones_sql('ss', 'dd')}, ct AS (SELECT *, row_number() OVER (PARTITION BY print ORDER BY started_ms, session, pos) AS nth FROM ss WHERE role = 'assistant')
SELECT session, count(*) AS excluded FROM ct LEFT JOIN dd USING (session) WHERE nth > 1 AND coalesce(pos > prefix, true) GROUP BY session""")
def d7_excluded_singles(spark, sf):
    s = _sessions(spark, sf)
    none = spark.createDataFrame([], "print string, owner long")
    _, duplicates, _ = clones.owners(s, none, spark.createDataFrame([], "session long, started_ms long"))
    return clones.ambiguous(s, duplicates, none).groupBy("session").agg(F.count("*").alias("excluded"))


# ---- a message store between runs


def _messages(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sessions, messages, watermarks, seen) of a second run: the first three turns were seen, some changed or were incomplete."""
    c = views.load(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    n, t = F.col("conv_id"), F.col("turn")
    c = c.select(n.cast("string").alias("session"), t.cast("string").alias("message"), "role", ((t - t % 2) * 1000).alias("created_ms"), n.alias("n"), t.alias("t"))
    n, t = F.col("n"), F.col("t")
    old = c.filter("t < 3")
    marks = old.groupBy("session").agg(F.max("created_ms").alias("watermark_ms"), F.lit(1).cast("long").alias("updated_ms"))
    seen = old.select("session", "message", F.concat_ws(":", F.lit("print"), "session", "message").alias("print"), "created_ms", ((F.col("role") == "assistant") & ((n + t) % 5 == 0)).alias("partial")).withColumnRenamed("created_ms", "updated_ms")
    now = c.select("session", "message", "role", "created_ms", (F.col("created_ms") + F.when((n + t) % 7 == 0, 1).otherwise(0)).alias("updated_ms"))
    sessions = c.groupBy("session").agg(F.when(F.min("n") % 3 == 0, 1).otherwise(2).cast("long").alias("updated_ms"))
    return sessions, now, marks, seen


@query("""WITH c AS (SELECT conv_id AS n, turn AS t, min(role) AS role FROM conversations GROUP BY ALL), top AS (SELECT n, max((t - t % 2) * 1000) AS mark FROM c WHERE t < 3 GROUP BY n)
SELECT CAST(n AS VARCHAR) AS session, CAST(t AS VARCHAR) AS message, t >= 3 OR (n + t) % 7 = 0 OR (role = 'assistant' AND (n + t) % 5 = 0) OR role = 'user' AS needs_parts,
  mark IS NULL OR t >= 3 OR (n + t) % 7 = 0 OR (role = 'assistant' AND (n + t) % 5 = 0) OR (t - t % 2) * 1000 >= mark AS account
FROM c LEFT JOIN top USING (n) WHERE (n % 3 <> 0 OR mark IS NULL) AND (t - t % 2) * 1000 <= 6000""")
def m2_reread_set(spark, sf):
    return messages.due(*_messages(spark, sf), 6000).select("session", "message", "account", "needs_parts")


# ---- merged inputs and claims


def _observed(spark, sf) -> DataFrame:
    """Four observations of each input, one of them retained from an earlier run."""
    e = views.events(spark, sf)
    n, k = F.col("id"), F.col("k")
    origin = F.expr("id div 4")
    whom = F.when(k % 6 == 0, "human").when(k % 6 == 1, "automated").otherwise("unknown")
    session = F.concat(F.lit("s"), (k % 3).cast("string"))
    return e.select(
        origin.alias("origin"), (n % 4 == 0).alias("retained"), n.alias("ordinal"), F.lit("omp").alias("agent"), session.alias("session"), session.alias("native_session"), F.concat(F.lit("i"), origin.cast("string")).alias("native_input"),
        F.concat(F.lit("src"), (n % 2).cast("string")).alias("source"), F.when(n % 5 != 0, origin * 1000 + F.when(k % 11 == 0, 7).otherwise(0)).alias("at_ms"), F.when(k % 4 < 2, "submission").when(k % 4 == 2, "replay").otherwise("unknown").alias("kind"),
        F.lit("recorded").alias("quality"), F.when(k % 8 == 3, F.array(F.lit("input-kind-unknown"))).otherwise(F.array().cast("array<string>")).alias("reasons"), whom.alias("by_whom"),
        F.when(k % 6 < 2, F.when(k % 4 < 2, "source").otherwise("provenance")).when(k % 25 == 3, "conflict").otherwise("none").alias("evidence"), F.when(k % 10 == 0, "c1").when(k % 10 == 1, "c2").alias("controller"),
    )


_OBSERVED = f"""{EVENTS_SQL}, ob AS (SELECT id // 4 AS origin, id % 4 = 0 AS retained, id AS ordinal, 's' || k % 3 AS session, 'src' || id % 2 AS source, CASE WHEN id % 5 <> 0 THEN id // 4 * 1000 + CASE WHEN k % 11 = 0 THEN 7 ELSE 0 END END AS at_ms,
  CASE WHEN k % 4 < 2 THEN 'submission' WHEN k % 4 = 2 THEN 'replay' ELSE 'unknown' END AS kind, CASE WHEN k % 8 = 3 THEN ['input-kind-unknown'] ELSE [] END AS reasons, CASE WHEN k % 6 = 0 THEN 'human' WHEN k % 6 = 1 THEN 'automated' ELSE 'unknown' END AS by_whom,
  CASE WHEN k % 6 < 2 THEN CASE WHEN k % 4 < 2 THEN 'source' ELSE 'provenance' END WHEN k % 25 = 3 THEN 'conflict' ELSE 'none' END AS evidence, CASE k % 10 WHEN 0 THEN 'c1' WHEN 1 THEN 'c2' END AS controller FROM ev)"""


@query(f"""WITH {_OBSERVED}, ow AS (SELECT * FROM ob QUALIFY row_number() OVER (PARTITION BY origin ORDER BY CASE WHEN NOT retained THEN 2 WHEN kind = 'replay' THEN 1 ELSE 0 END, coalesce(at_ms, 9223372036854775807), session, source, ordinal) = 1),
sl AS (SELECT ow.origin, ow.session, ow.at_ms AS owner_ms, coalesce(l, struct_pack(at_ms := ow.at_ms, kind := ow.kind, reasons := ow.reasons)) AS r FROM ow LEFT JOIN (SELECT origin, session, arg_max(struct_pack(at_ms := at_ms, kind := kind, reasons := reasons), ordinal) AS l FROM ob WHERE NOT retained GROUP BY ALL) USING (origin, session)),
ag AS (SELECT origin, count(DISTINCT by_whom) FILTER (by_whom <> 'unknown') AS whos, min(by_whom) FILTER (by_whom <> 'unknown') AS who, bool_or(evidence = 'conflict') AS sticky, bool_or(evidence = 'source' AND by_whom <> 'unknown') AS native, count(DISTINCT controller) AS cs, min(controller) AS c FROM ob GROUP BY origin),
ap AS (SELECT sl.origin, bool_or(ob.session <> sl.session AND ob.at_ms <> sl.owner_ms) AS apart FROM sl JOIN ob USING (origin) GROUP BY sl.origin)
SELECT origin, session, r.at_ms AS at_ms, CASE WHEN coalesce(apart, false) THEN 'unknown' ELSE r.kind END AS kind, CASE WHEN sticky OR whos > 1 OR who IS NULL THEN 'unknown' ELSE who END AS by_whom,
  CASE WHEN sticky OR whos > 1 THEN 'conflict' WHEN who IS NULL THEN 'none' WHEN native THEN 'source' ELSE 'provenance' END AS evidence, CASE WHEN NOT sticky AND cs = 1 THEN c END AS controller,
  array_to_string(list_sort(list_distinct(r.reasons || CASE WHEN coalesce(apart, false) THEN ['input-kind-unknown'] ELSE [] END || CASE WHEN sticky OR whos > 1 THEN ['input-origin-conflict'] ELSE [] END)), ',') AS reasons
FROM sl JOIN ag USING (origin) JOIN ap USING (origin)""")
def d5_input_merge(spark, sf):
    return merge.merged(_observed(spark, sf)).select("origin", "session", "at_ms", "kind", "by_whom", "evidence", "controller", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {EVENTS_SQL}, ip AS (SELECT id AS origin, agent, id // 2 AS key, at_ms, CASE WHEN k % 3 < 2 THEN 'submission' ELSE 'context' END AS kind, CASE k % 5 WHEN 0 THEN 'provenance' WHEN 1 THEN 'conflict' ELSE 'none' END AS evidence, CASE k % 5 WHEN 0 THEN 'human' ELSE 'unknown' END AS by_whom,
  CASE WHEN id % 7 = 0 THEN 'automated' END AS told FROM ev),
cl AS (SELECT DISTINCT agent, id // 2 AS key, CASE WHEN id % 4 = 0 THEN 'automated' ELSE 'human' END AS by_whom FROM ev WHERE id % 3 <> 1),
sd AS (SELECT agent, key, min(by_whom) AS a, max(by_whom) AS b FROM cl GROUP BY ALL), nn AS (SELECT agent, key, count(*) AS n FROM ip WHERE kind = 'submission' AND at_ms <= {CUTOFF_MS} GROUP BY ALL),
j AS (SELECT ip.*, a, b, coalesce(n, 0) AS n FROM ip LEFT JOIN sd USING (agent, key) LEFT JOIN nn USING (agent, key)),
o AS (SELECT *, CASE WHEN told IS NOT NULL THEN 'source' WHEN evidence = 'provenance' THEN 'none' ELSE evidence END AS oe, CASE WHEN told IS NOT NULL THEN told WHEN evidence = 'provenance' THEN 'unknown' ELSE by_whom END AS ow FROM j),
q AS (SELECT *, oe = 'conflict' OR a <> b OR (ow <> 'unknown' AND ow <> a) AS clash, n = 1 AND kind = 'submission' AND at_ms <= {CUTOFF_MS} AS settles, NOT (evidence = 'conflict' AND a <> b) AND (evidence = 'provenance' OR (evidence = 'conflict' AND told IS NOT NULL)) AS back FROM o)
SELECT origin, CASE WHEN a IS NULL THEN NULL WHEN n = 1 THEN 'settled' WHEN n = 0 THEN 'pending' ELSE 'ambiguous' END AS claim,
  CASE WHEN a IS NULL THEN by_whom WHEN settles THEN CASE WHEN clash THEN 'unknown' ELSE a END WHEN n <> 1 AND back THEN ow ELSE by_whom END AS by_whom,
  CASE WHEN a IS NULL THEN evidence WHEN settles THEN CASE WHEN clash THEN 'conflict' WHEN told IS NOT NULL THEN 'source' ELSE 'provenance' END WHEN n <> 1 AND back THEN oe ELSE evidence END AS evidence FROM q""")
def m5_reconciled_claims(spark, sf):
    e, n, k = views.events(spark, sf), F.col("id"), F.col("k")
    key = [F.col("agent"), F.lit("s").alias("native_session"), F.expr("cast(id div 2 as string)").alias("native_input")]
    i = e.select(n.alias("origin"), *key, "at_ms", F.when(k % 3 < 2, "submission").otherwise("context").alias("kind"), F.when(k % 5 == 0, "human").otherwise("unknown").alias("by_whom"), F.when(k % 5 == 0, "provenance").when(k % 5 == 1, "conflict").otherwise("none").alias("evidence"), F.lit(None).cast("string").alias("controller"), F.array().cast("array<string>").alias("reasons"))
    native = e.filter("id % 7 = 0").select(n.alias("origin"), F.lit("automated").alias("native_by_whom"), F.lit("source").alias("native_evidence"), F.lit(None).cast("string").alias("native_controller"))
    said = claims.retained(None, e.filter("id % 3 <> 1").select(*key, F.when(n % 4 == 0, "automated").otherwise("human").alias("by_whom"), F.lit(None).cast("string").alias("controller")))
    return claims.reconciled(i, native, said, CUTOFF_MS).select("origin", "claim", "by_whom", "evidence")


# ---- fork families


def _files(spark, sf) -> DataFrame:
    """A file for each user and event type: clicks share session ids, views and purchases name earlier files, some of them missing, signups lie below views."""
    e = views.events(spark, sf).groupBy(F.col("session").alias("u"), "event_type").agg(F.min("at_ms").alias("low"))
    u, t = F.col("u"), F.col("event_type")
    view = F.concat(F.lit("/s/"), u.cast("string"), F.lit("/view"))
    path = F.when(t == "signup", F.concat(view, F.lit("/kid"), (u % 2).cast("string"), F.lit(".jsonl"))).otherwise(F.concat(F.lit("/s/"), u.cast("string"), F.lit("/"), t, F.lit(".jsonl")))
    before = F.when((t == "view") & (u % 4 == 0), F.array(F.concat(F.lit("/s/"), (u + 1).cast("string"), F.lit("/view.jsonl")))).when((t == "purchase") & (u % 2 == 0), F.array(F.concat(F.lit("/gone/"), (u % 7).cast("string")))).otherwise(F.array().cast("array<string>"))
    return e.select(path.alias("path"), F.when(t == "click", F.concat(F.lit("h"), F.expr("cast(u div 3 as string)"))).otherwise(path).alias("session"), before.alias("previous"), F.when(u % 9 != 0, F.col("low")).alias("header_ms"), u.alias("u"), t.alias("event_type"))


_FILES = f"""{EVENTS_SQL}, f0 AS (SELECT session AS u, event_type AS t, min(at_ms) AS low FROM ev GROUP BY ALL),
f AS (SELECT u, t, CASE WHEN t = 'signup' THEN '/s/' || u || '/view/kid' || u % 2 || '.jsonl' ELSE '/s/' || u || '/' || t || '.jsonl' END AS path, CASE WHEN u % 9 <> 0 THEN low END AS header_ms FROM f0),
n AS (SELECT path AS x, CASE WHEN t = 'click' THEN 'id:' || u // 3 WHEN t = 'view' AND u % 4 = 0 THEN '/s/' || u + 1 || '/view.jsonl' WHEN t = 'purchase' AND u % 2 = 0 THEN '/gone/' || u % 7 END AS y FROM f),
e1 AS (SELECT x, y FROM n WHERE y IS NOT NULL), b1 AS (SELECT x, y FROM e1 UNION SELECT y, x FROM e1 UNION SELECT path, path FROM f),
r1(x, y) AS (SELECT x, y FROM b1 UNION SELECT r1.x, b1.y FROM r1 JOIN b1 ON r1.y = b1.x), c1 AS (SELECT x, min(y) AS c FROM r1 GROUP BY x),
kid AS (SELECT f.path AS x, 'kid:' || c1.c || ':' || f.u % 2 AS y FROM f JOIN c1 ON c1.x = '/s/' || f.u || '/view.jsonl' AND c1.x IN (SELECT path FROM f) WHERE f.t = 'signup'),
b2 AS (SELECT x, y FROM b1 UNION SELECT x, y FROM kid UNION SELECT y, x FROM kid), r2(x, y) AS (SELECT x, y FROM b2 UNION SELECT r2.x, b2.y FROM r2 JOIN b2 ON r2.y = b2.x),
fm AS (SELECT x AS path, min(y) AS family FROM r2 WHERE x IN (SELECT path FROM f) GROUP BY x),
cn AS (SELECT family, arg_min(f.path, (coalesce(header_ms, 9223372036854775807), f.path)) AS canonical FROM fm JOIN f USING (path) GROUP BY family)"""


def _families(spark, sf):
    from . import lineage

    files = _files(spark, sf)
    grouped = forks.families(files, lineage.families).checkpoint()
    return files, grouped, forks.canonical(files, grouped)


@query(f"WITH RECURSIVE {_FILES} SELECT path, canonical FROM fm JOIN cn USING (family)")
def g1_fork_families(spark, sf):
    _, grouped, first = _families(spark, sf)
    return grouped.join(first.select("family", F.col("path").alias("canonical")), "family").select("path", "canonical")


def _held(spark, sf, files) -> DataFrame:
    """Events with the path of their file."""
    return views.events(spark, sf).withColumnRenamed("session", "u").join(files.select("u", "event_type", "path"), ["u", "event_type"])


@query(f"""WITH RECURSIVE {_FILES}, i AS (SELECT ev.id, f.path, family, ev.session, k % 20 AS native, CASE WHEN ev.id % 6 <> 0 THEN at_ms END AS at_ms, CASE WHEN k % 4 < 3 THEN 'submission' ELSE 'unknown' END AS kind FROM ev JOIN f ON f.u = ev.session AND f.t = ev.event_type JOIN fm USING (path)),
o AS (SELECT i.*, i.path <> canonical AS aside FROM i JOIN cn USING (family)), w AS (SELECT family, native, count(*) AS n, min(struct_pack(a := aside, at := coalesce(at_ms, 9223372036854775807), s := session, p := path)) AS own FROM o GROUP BY ALL)
SELECT family_of, native, sum(CASE WHEN n > 1 THEN n - 1 ELSE 0 END)::BIGINT AS replays, sum(n)::BIGINT AS inputs FROM (SELECT canonical AS family_of, native, n FROM w JOIN cn USING (family)) GROUP BY ALL""")
def g5_replays(spark, sf):
    files, grouped, first = _families(spark, sf)
    k, n = F.col("k"), F.col("id")
    i = _held(spark, sf, files).select("id", "path", F.col("u").alias("session"), (k % 20).alias("native_input"), F.when(n % 6 != 0, F.col("at_ms")).alias("at_ms"), F.when(k % 4 < 3, "submission").otherwise("unknown").alias("kind"), F.lit("recorded").alias("quality"), F.array().cast("array<string>").alias("reasons"))
    out = forks.marked(i, grouped, first).join(first.select("family", F.col("path").alias("family_of")), "family")
    return out.groupBy("family_of", F.col("native_input").alias("native")).agg(F.count_if(F.col("kind") == "replay").alias("replays"), F.count("*").alias("inputs"))


@query(f"""WITH RECURSIVE {_FILES}, us AS (SELECT ev.id, f.path, family, canonical, f.path <> canonical AS aside, CASE WHEN k % 3 = 0 THEN 'model_usage' ELSE 'message' END AS kind, CASE WHEN ev.id % 4 = 0 THEN k % 30 END AS response, CASE WHEN ev.id % 4 < 3 THEN k % 40 END AS entry,
  k AS uncached, CASE WHEN ev.id % 5 <> 0 THEN 0 END AS cache_read, k % 2 AS output FROM ev JOIN f ON f.u = ev.session AND f.t = ev.event_type JOIN fm USING (path) JOIN cn USING (family)),
g AS (SELECT *, CASE WHEN response IS NOT NULL THEN 'r' || response WHEN entry IS NOT NULL THEN 'e' || canonical || ':' || entry ELSE 'p' || canonical || ':' || kind || uncached || ':' || coalesce(cache_read, -1) || ':' || output END AS origin FROM us)
SELECT arg_min(id, struct_pack(a := aside, b := kind <> 'message', c := -(CASE WHEN cache_read IS NULL THEN 2 ELSE 3 END), d := id, e := path)) AS id, count(*) > 1 AND (count(DISTINCT struct_pack(a := uncached, b := cache_read, c := output)) > 1 OR (count(response) = 0 AND count(DISTINCT kind) > 1)) AS conflict,
  CASE WHEN count(DISTINCT struct_pack(a := uncached, b := cache_read, c := output)) > 1 OR (count(response) = 0 AND count(DISTINCT kind) > 1) THEN count(*) - 1 ELSE 0 END AS excluded FROM g GROUP BY origin""")
def d4_family_usage(spark, sf):
    files, grouped, first = _families(spark, sf)
    k, n, null = F.col("k"), F.col("id"), F.lit(None).cast("bigint")
    u = _held(spark, sf, files).select(
        "path", n.alias("line"), F.when(k % 3 == 0, "model_usage").otherwise("message").alias("kind"), F.when(n % 4 == 0, k % 30).alias("response"), F.when(n % 4 < 3, k % 40).alias("entry"), null.alias("at_ms"), F.lit("p").alias("provider"), F.lit("m").alias("model"),
        k.alias("uncached"), F.when(n % 5 != 0, 0).cast("bigint").alias("cache_read"), null.alias("cache_write"), (k % 2).alias("output"), null.alias("reasoning"), null.alias("total"), F.lit("recorded").alias("quality"), F.array().cast("array<string>").alias("reasons"),
    )
    return forks.selected(u, grouped, first).select(F.col("line").alias("id"), (F.col("quality") == "partial").alias("conflict"), F.col("excluded").cast("bigint").alias("excluded"))


# ---- files of envelope lines


def _lines(spark, sf) -> DataFrame:
    """A file of envelope lines for each user, every fifth user's twice: a header, records of even events, and running totals at odd ones."""
    e = views.events(spark, sf)
    n, k, u = F.col("id"), F.col("k"), F.col("session")
    e = e.withColumns({"i": k * 10, "o": F.floor("value").cast("bigint")})
    w = Window.partitionBy("session").orderBy("at_ms", "id")
    e = e.withColumns({"si": F.sum("i").over(w), "so": F.sum("o").over(w), "nth": F.row_number().over(w)})
    counts = lambda i, o: F.struct(i.alias("input_tokens"), F.lit(0).alias("cached_input_tokens"), F.lit(0).alias("cache_write_input_tokens"), o.alias("output_tokens"), F.lit(0).alias("reasoning_output_tokens"), (i + o).alias("total_tokens"))
    record = F.to_json(F.struct(F.col("at_ms").alias("timestamp"), F.lit("token_usage_record").alias("type"), n.alias("ordinal"), F.struct(F.concat(F.lit("r"), n).alias("response_id"), counts(F.col("i"), F.col("o")).alias("usage")).alias("payload")))
    total = F.to_json(F.struct(F.col("at_ms").alias("timestamp"), F.lit("event_msg").alias("type"), n.alias("ordinal"), F.struct(F.lit("token_count").alias("type"), F.struct(counts(F.col("si"), F.col("so")).alias("total_token_usage")).alias("info")).alias("payload")))
    body = e.select(u.alias("u"), F.col("nth").cast("bigint").alias("offset"), F.when(n % 2 == 0, record).otherwise(total).alias("line"))
    head = e.select(u.alias("u")).distinct().select("u", F.lit(0).cast("bigint").alias("offset"), F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("s"), "u").alias("id"), F.lit("p").alias("model_provider"), F.when(F.col("u") % 7 == 0, F.array(F.lit("/gone"))).alias("previousSessionFiles")).alias("payload"))).alias("line"))
    both = head.unionByName(body)
    return both.select(F.concat(F.lit("/a/"), "u").alias("path"), "offset", "line").unionByName(both.filter("u % 5 = 0").select(F.concat(F.lit("/b/"), "u").alias("path"), "offset", "line"))


_ENVELOPES = f"""{EVENTS_SQL}, en AS (SELECT session, at_ms, id, k * 10 AS i, CAST(floor(value) AS BIGINT) AS o, id % 2 = 0 AS record, sum(CASE WHEN id % 2 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY at_ms, id) AS nth FROM ev)"""


@query(f"WITH {_ENVELOPES} SELECT 's' || session AS session, at_ms, i AS uncached, o AS output, i + o AS total, 'recorded' AS quality FROM en WHERE record OR (i + o > 0 AND NOT (session % 7 = 0 AND nth = 1))")
def s6_envelope_usage(spark, sf):
    return families.envelope_usage(_lines(spark, sf)).select("session", "at_ms", "uncached", "output", "total", "quality")


@query(f"""WITH {_ENVELOPES}, f AS (SELECT session, CASE WHEN session % 7 = 0 AND nth = 1 THEN 'unallocated-history' WHEN i + o > 0 THEN 'billed' ELSE 'even' END AS state FROM en WHERE NOT record)
SELECT path, state, count(*) AS checkpoints, CAST(1 AS BIGINT) AS epochs FROM (SELECT '/a/' || session AS path, state FROM f UNION ALL SELECT '/b/' || session, state FROM f WHERE session % 5 = 0) GROUP BY ALL""")
def s6_envelope_gaps(spark, sf):
    return families.envelope_gaps(_lines(spark, sf))


# ---- the document


def public_document(spark, sf) -> DataFrame:
    """The whole document of the given tables, as one row."""
    from . import catalog, document, status

    spine = clock.spine(spark, CUTOFF_MS, ZONE, 365)
    facts = views.usage(spark, sf).filter(F.col("at_ms") <= CUTOFF_MS).withColumn("date", clock.local_date("at_ms", ZONE))
    work = intervals.clip(views.work(spark, sf), F.col("start_ms"), F.lit(CUTOFF_MS))
    commits = catalog.a10_commits_daily(spark, sf).select(F.col("date").cast("date").alias("date"), "commits")
    i = views.inputs(spark, sf).withColumns({"quality": F.when(F.col("origin") % 41 == 0, "partial").otherwise("recorded"), "source": F.col("session") % 7})
    states = i.select("source").distinct().select("source", (F.col("source") != 3).alias("usable"))
    s = status.sources(spark, sf).groupBy("agent").agg(quality.combined("token_quality").alias("tokens"), quality.combined("work_quality").alias("work"), F.when(F.bool_and(F.col("state") == "available"), "available").otherwise("partial").alias("state"), quality.all_reasons("reasons").alias("reasons"))
    told = {"as_of": "2024-01-01", "pricing": ["https://prices.example/list"], "organization": "house", "timezone": ZONE, "cutoff": "2024-01-30T18:00:00.000Z", "unallocated": 0, "ambiguous": 0, "scope": "recorded"}
    days = document.days(spine, clock.slots(spine), facts, work, commits, ZONE)
    return document.assembled(days, document.input_ranges(i, states, work, catalog._ranges(spark), ZONE), s, facts.filter("at_ms is null"), told)


_DAYS = f"(SELECT CAST(d AS VARCHAR) AS date FROM (SELECT CAST(unnest(generate_series({local_date_sql(str(CUTOFF_MS))} - 364, {local_date_sql(str(CUTOFF_MS))}, INTERVAL 1 DAY)) AS DATE) AS d))"


@query(f"""WITH {USAGE_SQL}, {WORK_SQL.split('FROM events), ')[1]}, u AS (SELECT CAST({local_date_sql('at_ms')} AS VARCHAR) AS date, count(*) FILTER (decision = 'included') AS records, CASE WHEN count(total) FILTER (decision = 'included') > 0 THEN CAST(sum(total) FILTER (decision = 'included') AS BIGINT) END AS tokens,
  count(DISTINCT agent) AS agents FROM us WHERE at_ms <= {CUTOFF_MS} GROUP BY 1)
SELECT date, tokens, coalesce(records, 0) AS records, coalesce(agents, 0) AS agents FROM {_DAYS} LEFT JOIN u USING (date)""")
def k4_document_days(spark, sf):
    d = public_document(spark, sf).select(F.explode("days").alias("d")).select("d.*")
    return d.select("date", F.col("usage.total.value").alias("tokens"), (F.col("cost.pricedRecords") + F.col("cost.unpricedRecords")).alias("records"), F.size("scope.byHarness").cast("bigint").alias("agents"))
