"""Registered queries of collection: residual counters, the strict feed, scope from paths, messages and their parts, facts written by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import claims, cumulative, messages
from . import facts, views
from .catalog import query
from .views import EVENTS_SQL, USAGE_SQL

_NATIVE = ("input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens", "reasoning_tokens")


def _stores(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(sessions, counters by model) as a cumulative store has them: a session counts all its events, counters those of some types."""
    e = views.events(spark, sf)
    k, o, n = F.col("k"), F.floor("value").cast("bigint"), F.col("session")
    sums = [F.sum(k), F.sum(k % 7), F.lit(0).cast("bigint"), F.sum(o), F.sum(F.floor(F.col("value") / 4).cast("bigint"))]
    text = lambda c: F.lit(c).cast("string")
    rest = [text(None).alias(c) for c in ("billing_base_url", "billing_mode", "cost_status")] + [F.lit(None).cast("double").alias(c) for c in ("actual_cost_usd", "estimated_cost_usd")]
    at = lambda f: (f("at_ms") / 1000).cast("double")
    s = e.groupBy("session").agg(*[x.alias(c) for x, c in zip(sums, _NATIVE)], at(F.min).alias("started_at"), at(F.max).alias("last_activity_at"))
    s = s.select(text("/store").alias("path"), n.cast("string").alias("id"), text(None).alias("parent_session_id"), "started_at", F.lit(None).cast("double").alias("ended_at"), "last_activity_at", text("/w").alias("cwd"), text(None).alias("git_repo_root"), text("p").alias("billing_provider"), *_NATIVE, *rest)
    m = e.filter("event_type <> 'purchase'").groupBy("session", "event_type").agg(*[x.alias(c) for x, c in zip(sums, _NATIVE)], at(F.min).alias("first_seen"), at(F.max).alias("last_seen"))
    task = F.when(F.col("event_type") == "signup", "title").otherwise("")
    m = m.withColumn("cache_read_tokens", F.when(~((n % 10 == 0) & (F.col("event_type") == "view")), F.col("cache_read_tokens")))
    return s, m.select(text("/store").alias("path"), n.cast("string").alias("session_id"), F.col("event_type").alias("model"), text("p").alias("billing_provider"), task.alias("task"), "first_seen", "last_seen", *_NATIVE, *rest)


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT session, event_type IN ('purchase', 'signup') AS rest, bool_or(event_type = 'view' AND session % 10 = 0) AS lost, sum(k) AS i, sum(k % 7) AS r, sum(CAST(floor(value) AS BIGINT)) AS o, sum(CAST(floor(value / 4) AS BIGINT)) AS q FROM ev GROUP BY ALL),
a AS (SELECT session, sum(i) FILTER (rest) AS i, sum(r) FILTER (rest) AS r, sum(o) FILTER (rest) AS o, sum(q) FILTER (rest) AS q, bool_or(lost) AS lost FROM s GROUP BY session)
SELECT CAST(session AS VARCHAR) AS session, CAST(i AS BIGINT) AS uncached, CASE WHEN NOT lost THEN CAST(r AS BIGINT) END AS cache_read, CAST(o AS BIGINT) AS output, CAST(q AS BIGINT) AS reasoning, CASE WHEN NOT lost THEN CAST(i + r + o AS BIGINT) END AS total, lost AS partial
FROM a WHERE i > 0 OR (r > 0 AND NOT lost) OR o > 0 OR q > 0""")
def a27_residual_counters(spark, sf):
    """All counters of what sessions count beyond their counters without a task."""
    s, m = _stores(spark, sf)
    return cumulative.residuals(cumulative.sessions(s), cumulative.by_model(m)).select("session", "uncached", "cache_read", "output", "reasoning", "total", "partial")


_FEED = """CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'unsupported-schema' WHEN 3 THEN 'unsupported-schema' WHEN 4 THEN 'unsupported-schema' WHEN 5 THEN 'parse-gap' ELSE NULL END"""


@query(f"SELECT gap, by_whom, count(*) AS lines, count(DISTINCT session) AS sessions FROM (SELECT {_FEED} AS gap, CASE WHEN {_FEED} IS NULL THEN CASE WHEN event_id % 3 = 0 THEN 'human' ELSE 'automated' END END AS by_whom, CASE WHEN {_FEED} IS NULL THEN 's' || user_id END AS session FROM events) GROUP BY ALL")
def s17_strict_feed(spark, sf):
    """Feed lines of which some have another version, a key too many, an id that is a number, or no JSON at all."""
    e = views.load(spark, sf, "events")
    n = F.col("event_id")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    session = F.when(n % 8 == 4, F.col("user_id").cast("string")).otherwise(text(F.concat(F.lit("s"), F.col("user_id").cast("string"))))
    more = F.when(n % 8 == 3, ', "more": 1').when(n % 8 == 1, ', "controller": "c"').otherwise("")
    end = F.when(n % 8 == 5, "").otherwise("}")
    line = F.concat(F.lit('{"version": '), F.when(n % 8 == 2, "2").otherwise("1"), F.lit(', "agent": "omp", "sessionId": '), session, F.lit(', "inputId": '), text(n.cast("string")), F.lit(', "status": "delivered", "origin": '), text(F.when(n % 3 == 0, "human").otherwise("automated")), more, end)
    return claims.parsed(e.select(line.alias("line"))).groupBy("gap", F.col("claim.by_whom").alias("by_whom")).agg(F.count("*").alias("lines"), F.count_distinct("claim.native_session").alias("sessions"))


@query("""WITH t AS (SELECT DISTINCT user_id AS u, user_id % 10 AS n FROM events), f AS (SELECT *, u % 6 = 0 AS live FROM t)
SELECT CAST(u AS VARCHAR) AS session, CASE WHEN live AND n IN (4, 5, 6) THEN '/w/' || n WHEN live THEN NULL WHEN n = 7 THEN '/w/4' WHEN n = 8 AND u % 4 = 0 THEN '/w/5' END AS repository_key,
  CASE WHEN live AND n IN (4, 5, 6) THEN 'included' WHEN live THEN 'out-of-scope' WHEN n IN (1, 2) OR n = 7 OR (n = 8 AND u % 4 = 0) THEN 'included' ELSE 'out-of-scope' END AS decision,
  CASE WHEN live AND n IN (4, 5, 6) THEN 'repository-identity' WHEN live THEN 'unrelated-live-repository' WHEN n IN (1, 2) THEN 'configured-root' WHEN n = 7 THEN 'historical-prefix' WHEN n = 8 AND u % 4 = 0 THEN 'cached-attribution' ELSE 'outside-configured-scope' END AS scope_reason FROM f""")
def c6_present_scope(spark, sf):
    """The scope that stored sessions have now, from paths, roots, repositories, old mappings and earlier attributions."""
    u = views.load(spark, sf, "events").select(F.col("user_id").alias("u")).distinct()
    n, at = F.col("u") % 10, F.concat(F.lit("/w/"), (F.col("u") % 10).cast("string"))
    own = F.concat(at, F.lit("/"), F.col("u").cast("string"))
    tuples = u.select(F.lit("omp").alias("agent"), F.col("u").cast("string").alias("session"), own.alias("workspace"), F.lit(None).cast("string").alias("repository"))
    places = u.filter("u % 3 = 0").select(own.alias("path"), own.alias("live"), F.when(F.col("u") % 2 == 0, F.concat(at, F.lit("/.git"))).alias("common"))
    tops = u.select(n.alias("n"), at.alias("path")).distinct()
    repositories = tops.filter("n in (4, 5, 6)").select("path", F.concat("path", F.lit("/.git")).alias("common"))
    old = tops.filter("n = 7").select(F.lit(0).alias("nth"), "path", F.lit(False).alias("exact"), F.lit("/w/4").alias("repository"))
    was = u.filter(n == 8).select(F.lit("omp").alias("agent"), F.col("u").cast("string").alias("session"), own.alias("workspace"), F.when(F.col("u") % 4 == 0, "/w/5").otherwise("/nowhere").alias("repository"))
    out = facts.resolved(tuples, places, tops.filter("n in (1, 2)").select("path"), repositories, old, was)
    return out.select("session", "repository_key", "decision", "scope_reason")


@query("""WITH m AS (SELECT DISTINCT conv_id, turn, min(role) OVER (PARTITION BY conv_id, turn) AS role FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS session, CAST(turn AS VARCHAR) AS message, CASE WHEN turn % 4 < 3 THEN turn % 4 + 1 END AS n_parts, CASE WHEN turn % 4 < 3 THEN turn % 4 = 0 OR conv_id % 2 = 0 END AS plain_parts FROM m""")
def j8_message_parts(spark, sf):
    """Messages with one to three parts or none; second and third parts are files in every other conversation."""
    c = views.load(spark, sf, "conversations").select(F.col("conv_id").alias("c"), F.col("turn").alias("t")).distinct()
    session, message = F.col("c").cast("string").alias("session"), F.col("t").cast("string").alias("message")
    parts = c.filter("t % 4 < 3").withColumn("n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("t") % 4)))
    data = F.when((F.col("n") == 0) | (F.col("c") % 2 == 0), F.concat(F.lit('{"type": "text", "text": "part '), F.col("n").cast("string"), F.lit('"}'))).otherwise('{"type": "file", "path": "/x"}')
    held = messages.with_parts(c.select(session, message, F.lit(True).alias("needs_parts")), parts.select(session, message, F.col("n").cast("string").alias("part"), data.alias("data")))
    return held.select("session", "message", "n_parts", "plain_parts")


@query(f"""WITH {USAGE_SQL}, nw AS (SELECT origin, CASE WHEN origin % 13 = 0 THEN at_ms + 86400000 ELSE at_ms END AS at_ms, total FROM us WHERE origin % 5 = 0)
SELECT CAST(CAST(DATE '1970-01-01' + CAST(at_ms // 86400000 AS INTEGER) AS DATE) AS VARCHAR) AS day, count(*) AS records, CAST(sum(total) AS BIGINT) AS tokens FROM (SELECT * FROM nw UNION ALL SELECT origin, at_ms, total FROM us WHERE origin % 5 <> 0) GROUP BY 1""")
def k1_facts_by_day(spark, sf):
    """Usage written by day, then merged with a batch in which some facts moved to the next day."""
    import uuid

    from . import lineage

    u = views.usage(spark, sf).select("origin", "at_ms", "total")
    lineage.ready(u)
    folder = f"{spark.sparkContext.getCheckpointDir()}/facts-{uuid.uuid4()}"
    facts.merge(spark, folder, "usage", u, "origin", "at_ms")
    moved = F.when(F.col("origin") % 13 == 0, F.col("at_ms") + 86_400_000).otherwise(F.col("at_ms"))
    facts.merge(spark, folder, "usage", u.filter("origin % 5 = 0").withColumn("at_ms", moved), "origin", "at_ms")
    return facts.read(spark, folder, "usage").groupBy(facts.day_of("at_ms").alias("day")).agg(F.count("*").alias("records"), F.sum("total").alias("tokens"))
