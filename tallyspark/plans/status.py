"""Registered queries: evidence, statuses, record scope, input kinds and lanes, content prints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence, inputs, kinds
from . import views
from .catalog import query
from .views import AGENTS, EVENTS_SQL, INPUTS_SQL, USAGE_SQL, WORK_SQL

STATES = ("available", "available", "available", "partial", "available", "missing")
TOKENS = ("recorded", "recorded", "partial", "recorded", "unavailable", "recorded")
WORK = ("recorded", "partial", "recorded", "recorded", "recorded", "unavailable")
REASONS = ("", "timing-unavailable", "unknown-model,parse-gap", "", "missing-source", "open-interval")


def _pick(values: tuple[str, ...]):
    return F.element_at(F.array(*map(F.lit, values)), (F.col("h") + 1).cast("int"))


def sources(spark, sf) -> DataFrame:
    """Seven sources of each agent but one; what state they are in follows from the sum of their ids."""
    s = views.events(spark, sf).filter("agent <> 'hermes'").groupBy("agent", (F.col("session") % 7).alias("n")).agg((F.sum("id") % 6).alias("h"))
    reasons = F.filter(F.split(_pick(REASONS), ","), lambda x: x != "")
    return s.select(F.concat_ws(":", "agent", "n").alias("source"), "agent", _pick(STATES).alias("state"), _pick(TOKENS).alias("token_quality"), _pick(WORK).alias("work_quality"), reasons.alias("reasons"))


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "][CAST(h + 1 AS BIGINT)]"


_SOURCES = f"""{EVENTS_SQL}, sh AS (SELECT agent, session % 7 AS n, sum(id) % 6 AS h FROM ev WHERE agent <> 'hermes' GROUP BY ALL),
so AS (SELECT agent || ':' || n AS source, agent, {_list(STATES)} AS state, {_list(TOKENS)} AS token_quality, {_list(WORK)} AS work_quality, list_filter(string_split({_list(REASONS)}, ','), lambda x: x <> '') AS reasons FROM sh)"""
_ONE = "CASE WHEN count(*) FILTER ({q} = 'unavailable') = count(*) THEN 'unavailable' WHEN count(*) FILTER ({q} = 'recorded') = count(*) THEN 'recorded' ELSE 'partial' END"
_AGENTS = "(VALUES " + ", ".join(f"('{a}')" for a in AGENTS) + ") ag(agent)"
_WITHOUT = {"tokens": ("timing-unavailable", "open-interval", "stale-ref"), "work": ("unknown-model", "unallocated-history", "counter-discontinuity", "duplicate-ambiguity", "upstream-owned", "stale-ref")}


def _evidence_sql(name: str, column: str) -> str:
    out = ", ".join(f"'{x}'" for x in _WITHOUT[name])
    return f"""SELECT ag.agent, '{name}' AS dimension, coalesce(t.status, 'unavailable') AS status, CASE WHEN t.status IS NULL THEN 'missing-source' ELSE coalesce(r.reasons, '') END AS reasons FROM {_AGENTS}
LEFT JOIN (SELECT agent, {_ONE.format(q=column)} AS status FROM so GROUP BY agent) t USING (agent)
LEFT JOIN (SELECT agent, string_agg(DISTINCT x, ',' ORDER BY x) AS reasons FROM (SELECT agent, unnest(reasons) AS x FROM so) WHERE x NOT IN ({out}) GROUP BY agent) r USING (agent)"""


_EVIDENCE = f"{_SOURCES}, evd AS ({_evidence_sql('tokens', 'token_quality')} UNION ALL {_evidence_sql('work', 'work_quality')})"


@query(f"WITH {_EVIDENCE} SELECT * FROM evd")
def q4_source_evidence(spark, sf):
    return evidence.by_agent(sources(spark, sf), AGENTS).withColumn("reasons", F.array_join("reasons", ","))


@query(f"""WITH {_EVIDENCE} SELECT dimension, {_ONE.format(q='status')} AS status, coalesce((SELECT string_agg(DISTINCT x, ',' ORDER BY x) FROM (SELECT dimension AS d, unnest(string_split(reasons, ',')) AS x FROM evd) WHERE d = evd.dimension AND x <> ''), '') AS reasons FROM evd GROUP BY dimension""")
def q4_evidence_of_all(spark, sf):
    return evidence.of_all(evidence.by_agent(sources(spark, sf), AGENTS)).withColumn("reasons", F.array_join("reasons", ","))


@query(f"""WITH {_SOURCES}, c AS (SELECT g, list_contains(['codex', 'claude', 'omp'], agent) OR g = 'all' AS mine, so.* FROM so, (VALUES ('three'), ('all'), ('whole')) v(g))
SELECT g AS agents, CASE WHEN g = 'whole' THEN 'ok' WHEN count(DISTINCT agent) FILTER (mine) < CASE g WHEN 'all' THEN 5 ELSE 3 END OR NOT bool_and(state = 'available' AND token_quality = 'recorded' AND work_quality = 'recorded') FILTER (mine) THEN 'partial' ELSE 'ok' END AS status FROM c GROUP BY g""")
def q6_collection_status(spark, sf):
    s, git = sources(spark, sf), spark.createDataFrame([("available",)], "state string")
    good = s.filter("state = 'available' and token_quality = 'recorded' and work_quality = 'recorded'")
    agents = [r[0] for r in good.select("agent").distinct().collect()]  # five at most
    of = lambda name, df, some: evidence.collection(df, git, some, F.lit("complete")).select(F.lit(name).alias("agents"), "status")
    return of("three", s, ("codex", "claude", "omp")).unionByName(of("all", s, AGENTS)).unionByName(of("whole", good, tuple(agents)))


@query(f"""WITH {_SOURCES.replace(EVENTS_SQL, USAGE_SQL)}, e AS (SELECT c, origin FROM us, (VALUES ('all'), ('some'), ('none')) v(c) WHERE c = 'all' OR (c = 'some' AND origin % 2 = 0))
SELECT c AS evidence, CASE WHEN c = 'all' AND (SELECT count(*) FROM us) > 0 THEN 'recorded' ELSE 'partial' END AS status FROM (VALUES ('all'), ('some'), ('none')) v(c)""")
def q7_scope_status(spark, sf):
    u, good = views.usage(spark, sf), sources(spark, sf).filter("state = 'available'")
    of = lambda name, df: evidence.scope(df, u, good).select(F.lit(name).alias("evidence"), "status")
    return of("all", u).unionByName(of("some", u.filter("origin % 2 = 0"))).unionByName(of("none", u.limit(0)))


@query(f"""WITH {_EVIDENCE.replace(EVENTS_SQL, WORK_SQL)}, ln AS (SELECT agent, count(*) AS n FROM wk GROUP BY agent)
SELECT agent, CASE WHEN status = 'unavailable' AND coalesce(n, 0) > 0 THEN 'partial' ELSE status END AS status FROM evd LEFT JOIN ln USING (agent) WHERE dimension = 'work'""")
def q9_work_status(spark, sf):
    told = evidence.by_agent(sources(spark, sf), AGENTS).filter("dimension = 'work'")
    lanes = views.work(spark, sf).groupBy("agent").agg(F.lit(True).alias("lanes"))
    return told.join(lanes, "agent", "left").select("agent", evidence.work_status(F.col("status"), F.coalesce("lanes", F.lit(False))).alias("status"))


_SCOPED = """ses AS (SELECT DISTINCT agent, session, CASE WHEN session % 5 = 0 THEN 'unattributed' WHEN session % 5 < 4 THEN 'included' ELSE 'out-of-scope' END AS decision FROM us WHERE session % 11 <> 0),
sco AS (SELECT origin, us.agent || ':' || us.session % 7 AS source, CASE WHEN origin % 6 = 0 THEN 'included' WHEN origin % 6 = 1 THEN 'out-of-scope' ELSE coalesce(ses.decision, 'unattributed') END AS decision,
  CASE WHEN origin % 6 = 0 THEN 'configured-root' WHEN origin % 6 = 1 THEN 'outside-configured-scope' WHEN ses.decision IS NOT NULL THEN 'of-session' ELSE 'attribution-unavailable' END AS reason FROM us LEFT JOIN ses USING (agent, session))"""


def _scoped(spark, sf) -> DataFrame:
    u = views.usage(spark, sf).select("origin", "agent", "session")
    mod, five = F.col("origin") % 6, F.col("session") % 5
    own = u.filter(mod < 2).select("origin", F.when(mod == 0, "included").otherwise("out-of-scope").alias("decision"), F.when(mod == 0, "configured-root").otherwise("outside-configured-scope").alias("reason"))
    decision = F.when(five == 0, "unattributed").when(five < 4, "included").otherwise("out-of-scope")
    sessions = u.filter("session % 11 <> 0").select("agent", "session").distinct().select("agent", "session", decision.alias("decision"), F.lit("of-session").alias("reason"))
    return evidence.record_scope(u, own, sessions).withColumn("source", F.concat_ws(":", "agent", F.col("session") % 7))


@query(f"WITH {USAGE_SQL}, {_SCOPED} SELECT origin, decision, reason FROM sco")
def c3_record_scope(spark, sf):
    return _scoped(spark, sf).select("origin", "decision", "reason")


@query(f"WITH {USAGE_SQL}, {_SCOPED} SELECT count(*) AS rows, count(DISTINCT origin) AS origins, CAST(sum(total) AS BIGINT) AS known_total FROM sco JOIN us USING (origin)")
def c4_scope_evidence(spark, sf):
    e = _scoped(spark, sf).join(views.usage(spark, sf).select("origin", "total"), "origin")
    return e.agg(F.count("*").alias("rows"), F.count_distinct("origin").alias("origins"), F.sum("total").alias("known_total"))


@query(f"""WITH {_SOURCES.replace(EVENTS_SQL, USAGE_SQL)}, {_SCOPED}, n AS (SELECT source, count(*) FILTER (decision = 'unattributed') AS unattributed FROM sco GROUP BY source)
SELECT source, coalesce(unattributed, 0) AS unattributed, CASE WHEN unattributed > 0 AND token_quality = 'recorded' THEN 'partial' ELSE token_quality END AS token_quality, CASE WHEN unattributed > 0 AND work_quality = 'recorded' THEN 'partial' ELSE work_quality END AS work_quality,
  array_to_string(CASE WHEN unattributed > 0 THEN list_sort(list_distinct(list_append(reasons, 'unattributed-session'))) ELSE reasons END, ',') AS reasons FROM so LEFT JOIN n USING (source)""")
def c5_degraded_sources(spark, sf):
    out = evidence.degraded(sources(spark, sf), _scoped(spark, sf))
    return out.select("source", "unattributed", "token_quality", "work_quality", F.array_join("reasons", ",").alias("reasons"))


_COUNTED = "decision = 'included' AND at_ms IS NOT NULL AND kind = 'submission' AND lane = 'main'"


@query(f"""WITH {_EVIDENCE.replace(EVENTS_SQL, INPUTS_SQL)}, g AS (SELECT agent, count(*) AS inputs, count(DISTINCT session) AS sessions FROM inp WHERE {_COUNTED} AND agent <> 'opencode' GROUP BY agent)
SELECT CAST(sum(inputs) AS BIGINT) AS inputs, CAST(sum(sessions) AS BIGINT) AS sessions, CASE WHEN count(inputs) = 0 THEN 'unavailable' WHEN bool_or((inputs IS NOT NULL OR agent IN ('codex', 'claude')) AND status <> 'recorded') THEN 'partial' ELSE 'recorded' END AS status
FROM evd LEFT JOIN g USING (agent) WHERE dimension = 'tokens'""")
def a17_all_harnesses(spark, sf):
    counted = views.inputs(spark, sf).filter("decision = 'included' and agent <> 'opencode'").filter(inputs.exclusion() == "counted")
    groups = counted.groupBy("agent").agg(F.count("*").alias("inputs"), F.count_distinct("session").alias("sessions"))
    told = evidence.by_agent(sources(spark, sf), AGENTS).filter("dimension = 'tokens'").join(groups, "agent", "left")
    return evidence.all_harnesses(told.withColumn("enabled", F.col("agent").isin("codex", "claude")))


_ITEMS = "CASE id % 5 WHEN 0 THEN ['user.text', 'x'] WHEN 1 THEN ['plugins.recommendations', 'agents_md.instructions'] WHEN 2 THEN ['plugins.recommendations', 'y'] WHEN 3 THEN ['plugins.recommendations', NULL] ELSE [] END"
_BLOCKS = "CASE k % 5 WHEN 0 THEN ['tool_result', 'tool_use'] WHEN 1 THEN ['text', 'image'] WHEN 2 THEN ['text', NULL] WHEN 3 THEN [] END"


@query(f"""WITH {EVENTS_SQL}, x AS (SELECT id, k, {_ITEMS} AS items, {_BLOCKS} AS blocks, CASE id % 9 WHEN 0 THEN 'task-notification' WHEN 1 THEN 'human' WHEN 2 THEN 'peer' END AS origin, CASE WHEN k % 5 = 4 THEN CASE WHEN id % 2 = 0 THEN '' ELSE 'hello' END END AS t FROM ev)
SELECT id, CASE WHEN list_contains(items, 'user.text') THEN 'submission' WHEN len(items) > 0 AND len(list_filter(items, lambda i: coalesce(i IN ('plugins.recommendations', 'agents_md.instructions', 'environments.environment_context', 'skills.selected_skill_instructions'), false))) = len(items) THEN 'context' ELSE 'unknown' END AS envelope,
  CASE WHEN id % 13 = 0 OR k % 5 = 0 OR origin = 'task-notification' OR id % 17 = 0 THEN 'context' WHEN id % 19 = 0 OR origin IN ('human', 'peer') THEN 'submission' WHEN id % 23 = 0 THEN 'context' WHEN t IS NOT NULL THEN CASE WHEN t <> '' THEN 'submission' ELSE 'context' END
    WHEN len(blocks) = 0 THEN 'context' WHEN k % 5 = 1 THEN 'submission' ELSE 'unknown' END AS flat,
  CASE WHEN id % 3 = 0 THEN CASE WHEN id < k * 40 THEN 'replay' ELSE 'unknown' END WHEN id % 4 = 0 AND k % 2 = 0 THEN 'submission' ELSE 'unknown' END AS headed,
  CASE WHEN id % 4 = 3 THEN 'unknown' WHEN id % 6 > 0 OR k % 10 = 1 THEN 'context' WHEN id % 6 = 0 AND k % 10 > 1 AND id % 5 = 0 THEN 'submission' ELSE 'unknown' END AS platform,
  CASE WHEN id % 5 = 0 OR k % 2 = 0 THEN 'subagent' ELSE 'main' END AS lane FROM x""")
def p19_input_kinds(spark, sf):
    e, null = views.events(spark, sf), F.lit(None).cast("string")
    ident, k = F.col("id"), F.col("k")
    text = lambda *x: F.array(*[F.lit(v).cast("string") for v in x]).cast("array<string>")
    items = F.when(ident % 5 == 0, text("user.text", "x")).when(ident % 5 == 1, text("plugins.recommendations", "agents_md.instructions")).when(ident % 5 == 2, text("plugins.recommendations", "y")).when(ident % 5 == 3, text("plugins.recommendations", None)).otherwise(text())
    blocks = F.when(k % 5 == 0, text("tool_result", "tool_use")).when(k % 5 == 1, text("text", "image")).when(k % 5 == 2, text("text", None)).when(k % 5 == 3, text())
    origin = F.when(ident % 9 == 0, "task-notification").when(ident % 9 == 1, "human").when(ident % 9 == 2, "peer")
    plain = F.when(k % 5 == 4, F.when(ident % 2 == 0, "").otherwise("hello"))
    role, parent = F.when(ident % 4 == 3, "assistant").otherwise("user"), F.when(ident % 5 == 0, ident)
    display = F.when(k % 10 == 1, "async_delegation_complete").when(k % 10 == 0, "other")
    return e.select(
        "id", kinds.envelope(items).alias("envelope"), kinds.flat(ident % 13 == 0, blocks, plain, origin, F.when(ident % 17 == 0, "m").otherwise(null), ident % 19 == 0, ident % 23 == 0).alias("flat"),
        kinds.headed(ident % 4 == 0, k % 2 == 0, ident % 3 == 0, ident, k * 40).alias("headed"), kinds.platform(role, ident % 6, display, F.lit(0), ident % 5 == 0).alias("platform"), kinds.lane(parent, k % 2 == 0).alias("lane"),
    )


@query("""SELECT event_id, sha256('{"a":[1,{"z":' || k || '}],"k":' || k || ',"v":"' || event_type || '"}') AS print FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def p15_content_print(spark, sf):
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{"v": "'), "event_type", F.lit('", "k": '), k, F.lit(', "id": '), F.col("event_id").cast("string"), F.lit(', "a": [1, {"sessionID": "s", "z": '), k, F.lit("}]}"))
    return views.load(spark, sf, "events").select("event_id", kinds.content_print(text, ("id", "sessionID")).alias("print"))
