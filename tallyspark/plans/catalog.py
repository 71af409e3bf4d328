"""Every registered query of the ledger engine, and its independent SQL for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, pricing, quality
from ..operators import dedup, inputs, intervals, sequences, usage
from . import ledger, views
from .views import COMMITS_SQL, COUNTERS_SQL, CUTOFF_MS, EVENTS_SQL, INPUTS_SQL, TURNS_SQL, USAGE_SQL, WORK_SQL, ZONE, local_date_sql, midnight_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LANE = ["agent", "session"]
_D = local_date_sql("at_ms")
_UB = "uncached + cache_read + cache_write"


def query(sql: str):
    """Registers a query under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


def _text(df: DataFrame, *dates: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in dates})


def _dated(df: DataFrame, ms: str = "at_ms") -> DataFrame:
    return df.withColumn("date", clock.local_date(ms, ZONE).cast("string"))


def _included(spark, sf) -> DataFrame:
    return _dated(views.usage(spark, sf).filter("decision = 'included'"))


def _sum_sql(x: str, name: str) -> str:
    return f"CAST(sum({x}) AS BIGINT) AS {name}, CASE WHEN count({x}) = 0 THEN 'unavailable' WHEN count({x}) = count(*) AND bool_and(quality = 'recorded') THEN 'recorded' ELSE 'partial' END AS {name}_status"


_SUMS = ", ".join(_sum_sql(c, c) for c in usage.COUNTERS)


@query(f"WITH {USAGE_SQL} SELECT agent, count(*) AS records, {_SUMS} FROM us GROUP BY agent")
def a1_null_aware_sum(spark: SparkSession, sf: str) -> DataFrame:
    return usage.sums(views.usage(spark, sf), "agent")


@query(f"WITH {USAGE_SQL} SELECT CAST({_D} AS VARCHAR) AS date, count(*) AS records, {_SUMS} FROM us WHERE decision = 'included' GROUP BY 1")
def a2_usage_daily(spark, sf):
    return usage.sums(_included(spark, sf), "date")


_REST = "CASE WHEN total - (uncached + cache_read + cache_write + output) >= 0 THEN total - (uncached + cache_read + cache_write + output) END"


@query(f"WITH {USAGE_SQL} SELECT agent, {_sum_sql(_REST, 'other')} FROM us GROUP BY agent")
def a3_residual(spark, sf):
    return usage.residual(views.usage(spark, sf), "agent")


_CACHE = f"""SELECT {{keys}}, CASE WHEN prompt > 0 THEN r END AS cache_read, CASE WHEN prompt > 0 THEN prompt END AS prompt,
  CASE WHEN prompt IS NULL OR prompt <= 0 THEN 'unavailable' WHEN paired = records THEN 'recorded' ELSE 'partial' END AS status, round(r * 1.0 / nullif(prompt, 0), 6) AS share
FROM (SELECT {{keys}}, CAST(sum(CASE WHEN {_UB} IS NOT NULL THEN cache_read END) AS BIGINT) AS r, CAST(sum({_UB}) AS BIGINT) AS prompt, count({_UB}) AS paired, count(*) AS records FROM ({{rows}}) GROUP BY ALL)"""


@query(f"WITH {USAGE_SQL} " + _CACHE.format(keys="agent", rows="SELECT * FROM us"))
def a4_cache_basis(spark, sf):
    return usage.cache_basis(views.usage(spark, sf), "agent")


@query(f"WITH {USAGE_SQL} " + _CACHE.format(keys="provider, model", rows="SELECT * FROM us WHERE decision = 'included'"))
def v10_cache_share(spark, sf):
    return usage.cache_basis(_included(spark, sf), "provider", "model")


_PRICED = f"""{USAGE_SQL}, {pricing.rates_sql()}, pr AS (
  SELECT us.*, CASE WHEN NOT coalesce({_UB} + output = total AND coalesce(reasoning, 0) <= output, false) THEN 'incomplete-token-breakdown' WHEN total = 0 THEN NULL WHEN m IS NULL THEN 'unpriced-model'
      WHEN (uncached > 0 AND r0 IS NULL) OR (cache_read > 0 AND r1 IS NULL) OR (cache_write > 0 AND r2 IS NULL) OR (output > 0 AND r3 IS NULL) THEN 'unpriced-model' END AS why_unpriced,
    uncached * coalesce(r0, 0) + cache_read * coalesce(r1, 0) + cache_write * coalesce(r2, 0) + output * coalesce(r3, 0) AS nano
  FROM us LEFT JOIN rt ON {pricing.canonical_sql()} = m AND l = coalesce({_UB} > 272000, false))"""
_COST = """CAST(count(*) FILTER (why_unpriced IS NULL) AS BIGINT) AS priced_records, CAST(count(*) FILTER (why_unpriced IS NOT NULL) AS BIGINT) AS unpriced_records,
  CAST(coalesce(sum(coalesce(total, 0)) FILTER (why_unpriced IS NULL), 0) AS BIGINT) AS priced_tokens, CAST(coalesce(sum(coalesce(total, 0)) FILTER (why_unpriced IS NOT NULL), 0) AS BIGINT) AS unpriced_tokens,
  CAST(sum(nano) FILTER (why_unpriced IS NULL) AS BIGINT) AS nano_usd, coalesce(string_agg(DISTINCT why_unpriced, ',' ORDER BY why_unpriced), '') AS reasons"""


@query(f"WITH {_PRICED} SELECT origin, why_unpriced, CAST(CASE WHEN why_unpriced IS NULL THEN nano END AS BIGINT) AS nano_usd FROM pr")
def p8_price_rows(spark, sf):
    return pricing.priced(views.usage(spark, sf)).select("origin", "why_unpriced", "nano_usd")


@query(f"WITH {_PRICED} SELECT CAST({_D} AS VARCHAR) AS date, {_COST} FROM pr WHERE decision = 'included' GROUP BY 1")
def a5_priced_cost(spark, sf):
    return usage.priced_cost(_included(spark, sf), "date")


@query(f"""WITH {USAGE_SQL} SELECT agent, CAST(sum(cost_micro) FILTER (cost_kind = 'provider-reported') AS BIGINT) AS reported_micro, CAST(sum(cost_micro) FILTER (cost_kind = 'source-estimate') AS BIGINT) AS estimated_micro,
  count(*) FILTER (cost_kind = 'included') AS included_records, CASE WHEN count(*) FILTER (cost_kind = 'unknown') > 0 THEN 'partial' ELSE 'recorded' END AS status FROM us GROUP BY agent""")
def a6_source_cost(spark, sf):
    return usage.source_cost(views.usage(spark, sf), "agent")


@query(f"WITH {USAGE_SQL} SELECT CAST({_D} AS VARCHAR) AS date, agent, provider, model, count(*) AS records, {_SUMS} FROM us WHERE decision = 'included' GROUP BY ALL")
def a7_usage_by_model(spark, sf):
    return usage.sums(_included(spark, sf), "date", "agent", "provider", "model")


_SCOPE = "count(*) AS records, CAST(sum(coalesce(total, 0)) AS BIGINT) AS known_tokens, count(*) FILTER (total IS NULL) AS unknown_total"


@query(f"WITH {USAGE_SQL} SELECT agent, decision, {_SCOPE} FROM us GROUP BY ALL")
def a8_scope_coverage(spark, sf):
    return usage.scope_coverage(views.usage(spark, sf), "agent")


@query(f"WITH {USAGE_SQL} SELECT decision, agent, provider, model, quality, CAST(grouping(agent) AS TINYINT) AS is_total, {_SCOPE} FROM us GROUP BY GROUPING SETS ((decision), (decision, agent, provider, model, quality))")
def a9_scope_report(spark, sf):
    return usage.scope_report(views.usage(spark, sf))


_EVIDENCE = "evd AS (SELECT origin, agent, decision, total FROM us WHERE origin % 3 <> 0)"


@query(f"WITH {USAGE_SQL}, {_EVIDENCE}, al AS (SELECT * FROM evd UNION ALL SELECT origin, agent, decision, total FROM us WHERE NOT EXISTS (SELECT 1 FROM evd WHERE evd.origin = us.origin)) SELECT agent, decision, {_SCOPE} FROM al GROUP BY ALL")
def j1_scope_anti_union(spark, sf):
    u = views.usage(spark, sf).select("origin", "agent", "decision", "total")
    return usage.scope_coverage(usage.anti_union(u, u.filter("origin % 3 <> 0")), "agent")


@query(f"WITH {COMMITS_SQL} SELECT CAST({local_date_sql('committer_ms')} AS VARCHAR) AS date, count(*) AS commits FROM (SELECT DISTINCT repository, oid, committer_ms FROM cm) GROUP BY 1")
def a10_commits_daily(spark, sf):
    return _dated(views.commits(spark, sf).dropDuplicates(["repository", "oid"]), "committer_ms").groupBy("date").agg(F.count("*").alias("commits"))


@query(f"WITH {USAGE_SQL} SELECT agent, CAST(min({_D}) AS VARCHAR) AS first_date FROM us WHERE decision = 'included' GROUP BY agent")
def a11_first_usage(spark, sf):
    return _included(spark, sf).groupBy("agent").agg(F.min("date").alias("first_date"))


_OUT = "CASE WHEN at_ms IS NULL THEN 'undated' WHEN kind = 'context' THEN 'context' WHEN kind = 'replay' THEN 'replay' WHEN kind <> 'submission' THEN 'unknown-kind' WHEN lane = 'subagent' THEN 'subagent' WHEN lane <> 'main' THEN 'unknown-lane' ELSE 'counted' END AS outcome"


@query(f"WITH {INPUTS_SQL} SELECT agent, {_OUT}, count(*) AS inputs, count(DISTINCT session) AS sessions FROM inp WHERE decision = 'included' GROUP BY ALL")
def a14_input_population(spark, sf):
    return inputs.population(views.inputs(spark, sf), "agent")


def _ranges(spark, cutoff_ms: int = CUTOFF_MS) -> DataFrame:
    last = clock.local_date(F.lit(cutoff_ms), ZONE)
    r = spark.createDataFrame([(7,), (30,), (90,), (365,)], "days int")
    return r.select("days", clock.midnight(F.date_sub(last, F.col("days") - 1), ZONE).alias("from_ms"), F.lit(cutoff_ms).alias("to_ms"))


_LAST = local_date_sql(str(CUTOFF_MS))
_RANGES = f"rg AS (SELECT days, {midnight_sql(f'{_LAST} - CAST(days - 1 AS INTEGER)')} AS from_ms, {CUTOFF_MS} AS to_ms FROM (SELECT unnest([7, 30, 90, 365]) AS days))"


@query(f"WITH {INPUTS_SQL}, {_RANGES} SELECT days, {_OUT}, count(*) AS inputs, count(DISTINCT session) AS sessions FROM inp, rg WHERE decision = 'included' AND (at_ms IS NULL OR at_ms BETWEEN from_ms AND to_ms) GROUP BY ALL")
def a18_cadence_ranges(spark, sf):
    return inputs.population(inputs.ranged(views.inputs(spark, sf), _ranges(spark)), "days")


@query(f"""WITH {INPUTS_SQL}, {WORK_SQL.split('FROM events), ')[1]}, {_RANGES},
ob AS (SELECT days, from_ms, to_ms, agent, session, at_ms, kind, lane, decision, CASE WHEN origin % 41 = 0 THEN 'partial' ELSE 'recorded' END AS quality, session % 7 <> 3 AS usable, coalesce(at_ms BETWEEN from_ms AND to_ms, false) AS inside FROM inp, rg WHERE session % 2 = 0 OR (kind <> 'unknown' AND lane <> 'unknown')),
cs AS (SELECT days, to_ms, agent, session, count(*) FILTER (inside AND decision = 'included' AND kind = 'submission' AND lane = 'main') AS n, min(at_ms) FILTER (inside AND decision = 'included' AND kind = 'submission' AND lane = 'main') AS first_ms,
  bool_or(NOT usable OR (kind NOT IN ('context', 'replay') AND (at_ms IS NULL OR (inside AND (kind = 'unknown' OR lane = 'unknown' OR quality <> 'recorded'))))) AS history, bool_or(inside AND kind NOT IN ('context', 'replay') AND decision <> 'included') AS mixed FROM ob GROUP BY ALL HAVING n > 0),
cl AS (SELECT days, agent, session, greatest(start_ms, first_ms) AS a, least(end_ms, to_ms) AS b FROM wk JOIN cs USING (agent, session) WHERE NOT history AND NOT mixed AND least(end_ms, to_ms) > greatest(start_ms, first_ms)),
rn AS (SELECT *, coalesce(max(b) OVER (PARTITION BY days, agent, session ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a) AS reach FROM cl),
w AS (SELECT days, agent, session, sum(greatest(0, b - greatest(a, reach))) AS ms FROM rn GROUP BY ALL)
SELECT days, agent, CASE WHEN history THEN 'input-history' WHEN mixed THEN 'mixed-scope' WHEN ms IS NULL THEN 'no-recorded-work' ELSE 'measured' END AS state, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS inputs, CAST(sum(ms) AS BIGINT) AS work_ms
FROM cs LEFT JOIN w USING (days, agent, session) GROUP BY ALL""")
def a16_cadence_cohort(spark, sf):
    i = views.inputs(spark, sf).filter("session % 2 = 0 or (kind <> 'unknown' and lane <> 'unknown')")
    i = i.withColumns({"quality": F.when(F.col("origin") % 41 == 0, "partial").otherwise("recorded"), "source": F.col("session") % 7})
    states = i.select("source").distinct().select("source", (F.col("source") != 3).alias("usable"))
    return inputs.cadence(i, states, views.work(spark, sf), _ranges(spark), ZONE, "agent")


def _series_sql(key: str) -> str:
    return f"""WITH {USAGE_SQL}, dy AS (SELECT CAST({_D} AS VARCHAR) AS date, {key} AS key, CASE WHEN count(total) = count(*) THEN CAST(sum(total) AS BIGINT) END AS tokens, sum(coalesce(total, 0)) AS known FROM us WHERE decision = 'included' GROUP BY ALL)
SELECT date, key, tokens, CAST(key_total AS BIGINT) AS key_total FROM dy JOIN (SELECT key, sum(known) AS key_total FROM dy GROUP BY key HAVING sum(known) > 0) USING (key)"""


@query(_series_sql("model"))
def a24_series_model(spark, sf):
    return usage.series(_included(spark, sf), "model")


@query(_series_sql("agent"))
def a24_series_harness(spark, sf):
    return usage.series(_included(spark, sf), "agent")


# ---- work: slots and sweeps. The other engine cuts each slot at all its boundaries and counts lanes over each part.

_MID = midnight_sql("d")
_NEXT = midnight_sql("d + 1")
_FAN = f"""{WORK_SQL}, dd AS (SELECT wk.*, unnest(generate_series({local_date_sql('start_ms')}, {local_date_sql('(end_ms - 1)')}, INTERVAL 1 DAY))::DATE AS d FROM wk),
de AS (SELECT *, {_MID} AS m0, {_NEXT} AS m1 FROM dd), dg AS (SELECT *, greatest(start_ms, m0) AS s0, least(end_ms, m1) AS e0 FROM de),
dh AS (SELECT *, unnest(range((s0 - m0) // 3600000, (e0 - 1 - m0) // 3600000 + 1)) AS slot FROM dg WHERE e0 > s0),
fan AS (SELECT origin, agent, session, kind, CAST(d AS VARCHAR) AS date, CAST(slot AS INTEGER) AS slot, greatest(s0, m0 + slot * 3600000) AS s, least(e0, m0 + (slot + 1) * 3600000) AS e FROM dh)"""


def _sweep_sql(keys: str, lane: str, where: str = "") -> str:
    return f"""WITH {_FAN}, f AS (SELECT DISTINCT {keys}, {lane} AS lane, s, e FROM fan {where}),
pt AS (SELECT DISTINCT {keys}, t FROM (SELECT {keys}, s AS t FROM f UNION ALL SELECT {keys}, e FROM f)),
sg AS (SELECT {keys}, t AS a, lead(t) OVER (PARTITION BY {keys} ORDER BY t) AS b FROM pt),
lv AS (SELECT {', '.join(f'sg.{k}' for k in keys.split(', '))}, a, b, count(DISTINCT lane) AS n FROM sg JOIN f ON {' AND '.join(f'sg.{k} = f.{k}' for k in keys.split(', '))} AND f.s <= a AND f.e >= b WHERE b IS NOT NULL GROUP BY ALL),
hs AS (SELECT {keys}, n, sum(b - a) AS ms FROM lv GROUP BY ALL)
SELECT {keys}, CAST(sum(ms) AS BIGINT) AS active_ms, CAST(sum(ms * n) AS BIGINT) AS agent_ms, CAST(coalesce(sum(ms) FILTER (n > 1), 0) AS BIGINT) AS parallel_ms, string_agg(n || ':' || ms, ',' ORDER BY n) AS histogram FROM hs GROUP BY ALL"""


def _fan(spark, sf) -> DataFrame:
    return _text(intervals.fan_out(views.work(spark, sf), ZONE), "date")


@query(_sweep_sql("date, slot", "agent || ':' || session"))
def i5_sweep_hourly(spark, sf):
    return intervals.stats(_fan(spark, sf), ["date", "slot"], LANE)


@query(_sweep_sql("date, slot, agent", "session"))
def i5_sweep_by_harness(spark, sf):
    return intervals.stats(_fan(spark, sf), ["date", "slot", "agent"], ["session"])


@query(_sweep_sql("date, slot", "agent || ':' || session", "WHERE kind = 'inference'"))
def i6_inference(spark, sf):
    return intervals.stats(_fan(spark, sf).filter("kind = 'inference'"), ["date", "slot"], LANE)


@query(f"WITH {_FAN} SELECT origin, date, slot, s AS start_ms, e AS end_ms FROM fan")
def i3_slot_fanout(spark, sf):
    return _fan(spark, sf).select("origin", "date", "slot", "start_ms", "end_ms")


_ISLANDS = """SELECT agent, session, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (SELECT *, sum(fresh) OVER (PARTITION BY agent, session ORDER BY start_ms, end_ms, origin ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY agent, session ORDER BY start_ms, end_ms, origin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {rows})) GROUP BY agent, session, g"""


@query(f"WITH {WORK_SQL} " + _ISLANDS.format(rows="wk"))
def i2_lane_union(spark, sf):
    return intervals.union(views.work(spark, sf), *LANE)


@query(f"""WITH {WORK_SQL}, wt AS (SELECT agent, session, start_ms + 1000 AS start_ms, start_ms + 1000 + (end_ms - start_ms) // 2 AS end_ms FROM wk WHERE origin % 3 = 0 AND (end_ms - start_ms) // 2 > 0),
pt AS (SELECT DISTINCT agent, session, t FROM (SELECT agent, session, unnest([start_ms, end_ms]) AS t FROM wk UNION ALL SELECT agent, session, unnest([start_ms, end_ms]) FROM wt)),
sg AS (SELECT agent, session, t AS start_ms, lead(t) OVER (PARTITION BY agent, session ORDER BY t) AS end_ms FROM pt),
ok AS (SELECT sg.*, 0 AS origin FROM sg WHERE end_ms IS NOT NULL AND EXISTS (SELECT 1 FROM wk w WHERE w.agent = sg.agent AND w.session = sg.session AND w.start_ms <= sg.start_ms AND w.end_ms >= sg.end_ms)
  AND NOT EXISTS (SELECT 1 FROM wt w WHERE w.agent = sg.agent AND w.session = sg.session AND w.start_ms <= sg.start_ms AND w.end_ms >= sg.end_ms))
""" + _ISLANDS.format(rows="ok"))
def i4_subtract_waits(spark, sf):
    w = views.work(spark, sf)
    half = F.expr("(end_ms - start_ms) div 2")
    waits = w.filter((F.col("origin") % 3 == 0) & (half > 0)).select(*LANE, (F.col("start_ms") + 1000).alias("start_ms"), (F.col("start_ms") + 1000 + half).alias("end_ms"))
    return intervals.subtract(w, waits, *LANE)


def _hourly(spark, sf) -> DataFrame:
    """Every slot of the last 365 days with its work, null where none was recorded."""
    slots = _text(clock.slots(clock.spine(spark, CUTOFF_MS, ZONE, 365)), "date")
    return slots.join(i5_sweep_hourly(spark, sf), ["date", "slot"], "left")


_SPINE = f"""sp AS (SELECT d, {_MID} AS m0, least({_NEXT}, {CUTOFF_MS}) AS m1 FROM (SELECT CAST(unnest(generate_series({_LAST} - 364, {_LAST}, INTERVAL 1 DAY)) AS DATE) AS d)),
sl AS (SELECT CAST(d AS VARCHAR) AS date, CAST(i AS INTEGER) AS slot, m0 + i * 3600000 AS slot_start, least(m0 + (i + 1) * 3600000, m1) AS slot_end FROM (SELECT *, unnest(range(0, (m1 - m0 + 3599999) // 3600000)) AS i FROM sp))"""
_HOURLY = f"WITH {_SPINE}, sw AS ({_sweep_sql('date, slot', chr(39).join(['agent || ', ':', ' || session']))}), hr AS (SELECT sl.*, active_ms, agent_ms, parallel_ms, histogram FROM sl LEFT JOIN sw USING (date, slot))"


def _cut_off(where: str = "") -> str:
    """The hourly sweep of work up to the cutoff."""
    return _sweep_sql("date, slot", "agent || ':' || session", where).replace("FROM dh)", f"FROM dh), fan0 AS (SELECT * FROM fan)", 1).replace("e FROM fan ", f"least(e, {CUTOFF_MS}) AS e FROM fan0 WHERE s < {CUTOFF_MS} ", 1)


@query(f"""WITH {_SPINE}, sw AS ({_cut_off()}), inf AS ({_cut_off("AND kind = 'inference'")}), fw AS (SELECT min(date) AS d FROM sw),
  hr AS (SELECT sl.date, sl.slot, slot_end - slot_start AS elapsed_ms, sw.active_ms, inf.active_ms AS inf_ms, sw.agent_ms, sw.parallel_ms, sw.histogram, sl.date >= fw.d AS known FROM sl LEFT JOIN sw USING (date, slot) LEFT JOIN inf USING (date, slot) CROSS JOIN fw)
  SELECT date, slot, elapsed_ms, CASE WHEN known THEN coalesce(active_ms, 0) ELSE active_ms END AS active_ms, CASE WHEN known OR active_ms IS NOT NULL THEN coalesce(inf_ms, 0) END AS inference_ms, CASE WHEN known THEN coalesce(agent_ms, 0) ELSE agent_ms END AS agent_ms,
    CASE WHEN known THEN coalesce(parallel_ms, 0) ELSE parallel_ms END AS parallel_ms, CASE WHEN known OR active_ms IS NOT NULL THEN concat_ws(',', CASE WHEN elapsed_ms > coalesce(active_ms, 0) THEN '0:' || (elapsed_ms - coalesce(active_ms, 0)) END, histogram) END AS histogram,
    CASE WHEN known OR active_ms IS NOT NULL THEN 'recorded' ELSE 'unavailable' END AS status FROM hr""")
def i5_slot_stats(spark, sf):
    work = intervals.clip(_fan(spark, sf), F.col("start_ms"), F.lit(CUTOFF_MS))
    slots = _text(clock.slots(clock.spine(spark, CUTOFF_MS, ZONE, 365)), "date").select("date", "slot", (F.col("slot_end") - F.col("slot_start")).alias("elapsed_ms"))
    first = work.agg(F.min("date").alias("first"))  # one row
    known = F.coalesce(F.col("date") >= F.col("first"), F.lit(False))
    out = intervals.in_windows(slots.crossJoin(F.broadcast(first)), work, ["date", "slot"], LANE, F.col("elapsed_ms"), known)
    return out.select("date", "slot", "elapsed_ms", "active_ms", "inference_ms", "agent_ms", "parallel_ms", "histogram", "status")


@query(_HOURLY + """ SELECT date, count(*) AS slots, count(active_ms) AS recorded_slots, CAST(sum(slot_end - slot_start) AS BIGINT) AS elapsed_ms, CAST(sum(active_ms) AS BIGINT) AS active_ms,
  round(sum(active_ms) * 1.0 / nullif(sum(slot_end - slot_start), 0), 6) AS uptime FROM hr GROUP BY date""")
def v3_uptime(spark, sf):
    elapsed = F.sum(F.col("slot_end") - F.col("slot_start"))
    return _hourly(spark, sf).groupBy("date").agg(F.count("*").alias("slots"), F.count("active_ms").alias("recorded_slots"), elapsed.alias("elapsed_ms"), F.sum("active_ms").alias("active_ms"), F.round(F.try_divide(F.sum("active_ms") * 1.0, elapsed), 6).alias("uptime"))


@query(_HOURLY + """ SELECT date, CAST(sum(agent_ms) AS BIGINT) AS agent_ms, round(sum(agent_ms) * 1.0 / nullif(sum(slot_end - slot_start), 0), 6) AS mean_lanes, round(sum(agent_ms) * 1.0 / nullif(sum(active_ms), 0), 6) AS busy_lanes,
  round(sum(parallel_ms) * 1.0 / nullif(sum(active_ms), 0), 6) AS parallel_share FROM hr GROUP BY date""")
def v4_concurrency(spark, sf):
    share = lambda a, b, name: F.round(F.try_divide(F.sum(a) * 1.0, b), 6).alias(name)
    return _hourly(spark, sf).groupBy("date").agg(F.sum("agent_ms").alias("agent_ms"), share("agent_ms", F.sum(F.col("slot_end") - F.col("slot_start")), "mean_lanes"), share("agent_ms", F.sum("active_ms"), "busy_lanes"), share("parallel_ms", F.sum("active_ms"), "parallel_share"))


_LOCAL_HOUR = f"timezone('{ZONE}', timezone('UTC', make_timestamp(slot_start * 1000)))"


@query(_HOURLY + f""", cell AS (SELECT CAST(dayofweek({_LOCAL_HOUR}) AS INTEGER) AS weekday, CAST(hour({_LOCAL_HOUR}) AS INTEGER) AS hour, CAST(sum(slot_end - slot_start) AS BIGINT) AS elapsed_ms, CAST(coalesce(sum(active_ms), 0) AS BIGINT) AS active_ms FROM hr GROUP BY ALL),
  grid AS (SELECT CAST(w AS INTEGER) AS weekday, CAST(h AS INTEGER) AS hour FROM range(7) a(w), range(24) b(h))
  SELECT weekday, hour, coalesce(elapsed_ms, 0) AS elapsed_ms, coalesce(active_ms, 0) AS active_ms FROM grid LEFT JOIN cell USING (weekday, hour)""")
def a25_rhythm(spark, sf):
    local = F.from_utc_timestamp(F.timestamp_millis("slot_start"), ZONE)
    cells = _hourly(spark, sf).groupBy((F.dayofweek(local) - 1).alias("weekday"), F.hour(local).alias("hour")).agg(F.sum(F.col("slot_end") - F.col("slot_start")).alias("elapsed_ms"), F.coalesce(F.sum("active_ms"), F.lit(0)).alias("active_ms"))
    grid = spark.range(168).select(F.expr("cast(id div 24 as int)").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    return grid.join(cells, ["weekday", "hour"], "left").select("weekday", "hour", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("elapsed_ms", "active_ms")])


@query(_HOURLY + """, parts AS (SELECT date, unnest(string_split(histogram, ',')) AS p FROM hr WHERE histogram IS NOT NULL), lv AS (SELECT date, CAST(split_part(p, ':', 1) AS INTEGER) AS n, CAST(split_part(p, ':', 2) AS BIGINT) AS ms FROM parts)
  SELECT date, CASE WHEN n <= 4 THEN CAST(n AS VARCHAR) WHEN n <= 7 THEN '5-7' ELSE '8+' END AS bin, CAST(sum(ms) AS BIGINT) AS ms FROM lv GROUP BY ALL""")
def a26_concurrency_bins(spark, sf):
    lv = intervals.levels(_fan(spark, sf), ["date", "slot"], LANE)
    slots = _text(clock.slots(clock.spine(spark, CUTOFF_MS, ZONE, 365)), "date").select("date", "slot")
    n = F.col("lanes")
    return lv.join(slots, ["date", "slot"], "left_semi").groupBy("date", F.when(n <= 4, n.cast("string")).when(n <= 7, "5-7").otherwise("8+").alias("bin")).agg(F.sum("ms").alias("ms"))


@query(_HOURLY + """, act AS (SELECT row_number() OVER (ORDER BY slot_start) AS i, coalesce(active_ms, 0) > 0 AS on_, date FROM hr), dy AS (SELECT row_number() OVER (ORDER BY date) AS i, bool_or(on_) AS on_ FROM act GROUP BY date),
  runs AS (SELECT 'hourly' AS streak, i - row_number() OVER (ORDER BY i) AS r FROM act WHERE on_ UNION ALL SELECT 'daily', i - row_number() OVER (ORDER BY i) FROM dy WHERE on_)
  SELECT streak, max(n) AS longest FROM (SELECT streak, r, count(*) AS n FROM runs GROUP BY ALL) GROUP BY streak""")
def v2_streaks(spark, sf):
    # Positions follow from the date and slot, so nothing is ordered in one task but what is left: a year has 8,760 slots.
    on = _hourly(spark, sf).filter("active_ms > 0")
    hours = on.select(F.lit("hourly").alias("streak"), F.expr(f"slot_start div {clock.HOUR}").alias("i"))
    days = on.select(F.lit("daily").alias("streak"), F.unix_date(F.to_date("date")).cast("bigint").alias("i")).distinct()
    return sequences.longest_run(hours.unionByName(days), ["streak"], "i")


_T1 = f"{EVENTS_SQL}, tz AS (SELECT DISTINCT CAST(d + CAST(n AS INTEGER) AS DATE) AS d FROM (SELECT DISTINCT {_D} AS d FROM ev), (SELECT unnest([0, 60, 290]) AS n))"


@query(f"WITH {_T1} SELECT CAST(d AS VARCHAR) AS date, CAST(i AS INTEGER) AS slot, m0 + i * 3600000 AS slot_start, least(m0 + (i + 1) * 3600000, m1) AS slot_end FROM (SELECT d, m0, m1, unnest(range(0, (m1 - m0 + 3599999) // 3600000)) AS i FROM (SELECT d, {_MID} AS m0, {_NEXT} AS m1 FROM tz))")
def t1_slots_dst(spark, sf):
    """Slots of the events' dates, and of those 60 and 290 days later, when clocks change."""
    d = views.events(spark, sf).select(clock.local_date("at_ms", ZONE).alias("d")).distinct()
    d = d.select(F.explode(F.transform(F.array(F.lit(0), F.lit(60), F.lit(290)), lambda n: F.date_add("d", n))).alias("date")).distinct()
    return _text(clock.slots(d.select("date", clock.midnight("date", ZONE).alias("start_ms"), clock.midnight(F.date_add("date", 1), ZONE).alias("end_ms"))), "date")


_END = f"{EVENTS_SQL}, ct AS (SELECT max(at_ms) AS c, {local_date_sql('max(at_ms)')} AS l FROM ev)"


def _cutoff(spark, sf) -> int:
    """The last event's time: one number."""
    return views.events(spark, sf).agg(F.max("at_ms")).first()[0]


@query(f"WITH {_END} SELECT CAST(d AS VARCHAR) AS date, {_MID} AS start_ms, least({_NEXT}, c) AS end_ms FROM (SELECT c, CAST(unnest(generate_series(l - 364, l, INTERVAL 1 DAY)) AS DATE) AS d FROM ct)")
def t3_day_spine(spark, sf):
    return _text(clock.spine(spark, _cutoff(spark, sf), ZONE, 365), "date")


_DAILY = f"""{USAGE_SQL}, {COMMITS_SQL}, sp AS (SELECT CAST(unnest(generate_series({_LAST} - 364, {_LAST}, INTERVAL 1 DAY)) AS DATE) AS d),
ud AS (SELECT {_D} AS d, CAST(sum(total) AS BIGINT) AS tokens FROM us WHERE decision = 'included' AND at_ms <= {CUTOFF_MS} GROUP BY 1), cd AS (SELECT {local_date_sql('committer_ms')} AS d, count(*) AS commits FROM cm GROUP BY 1)"""


def _daily(spark, sf) -> DataFrame:
    days = _text(clock.spine(spark, CUTOFF_MS, ZONE, 365), "date").select("date")
    tokens = _included(spark, sf).filter(F.col("at_ms") <= CUTOFF_MS).groupBy("date").agg(F.sum("total").alias("tokens"))
    return days.join(tokens, "date", "left").join(a10_commits_daily(spark, sf), "date", "left")


@query(f"WITH {_DAILY}, j AS (SELECT CAST(d AS VARCHAR) AS date, tokens, max(tokens) OVER () AS top FROM sp LEFT JOIN ud USING (d)) SELECT date, tokens, CAST(CASE WHEN coalesce(tokens, 0) <= 0 THEN 0 ELSE greatest(1, ceil(tokens * 4.0 / top)) END AS INTEGER) AS level FROM j")
def v6_calendar_levels(spark, sf):
    d = _daily(spark, sf).select("date", "tokens")
    top = d.agg(F.max("tokens").alias("top"))  # one row
    level = F.when(F.coalesce("tokens", F.lit(0)) <= 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.col("tokens") * 4.0 / F.col("top"))))
    return d.crossJoin(F.broadcast(top)).select("date", "tokens", level.cast("int").alias("level"))


@query(_HOURLY + f", {_DAILY.replace('sp AS', 'sp2 AS')} SELECT CAST(sp2.d AS VARCHAR) AS date, tokens, commits, active_ms, agent_ms FROM sp2 LEFT JOIN ud USING (d) LEFT JOIN cd USING (d) LEFT JOIN (SELECT CAST(date AS DATE) AS d, CAST(sum(active_ms) AS BIGINT) AS active_ms, CAST(sum(agent_ms) AS BIGINT) AS agent_ms FROM hr GROUP BY 1) USING (d)")
def v13_daily_table(spark, sf):
    work = _hourly(spark, sf).groupBy("date").agg(F.sum("active_ms").alias("active_ms"), F.sum("agent_ms").alias("agent_ms"))
    return _daily(spark, sf).join(work, "date", "left")


# ---- choosing records

_COPIES = f"cp AS (SELECT origin // 5 AS key, origin AS ordinal, quality, reasons, {', '.join(dedup.COUNTED)}, provider, model, cost_kind, session FROM us)"


def _copies(spark, sf) -> DataFrame:
    return views.usage(spark, sf).select(F.expr("origin div 5").alias("key"), F.col("origin").alias("ordinal"), "quality", "reasons", *dedup.COUNTED, "provider", "model", "cost_kind", "session")


_SCORE = "CASE quality WHEN 'recorded' THEN 100 WHEN 'partial' THEN 50 ELSE 0 END + " + " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in dedup.COUNTED)


_KNOWN = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in dedup.COUNTED)
_DIFFERS = "(f.gap OR (s.score = f.score AND s.told IS DISTINCT FROM f.told))"


# The other engine folds the records one by one.
@query(f"""WITH RECURSIVE {USAGE_SQL}, {_COPIES}, sc AS (SELECT key, ordinal, {_SCORE} AS score, {_KNOWN} AS known, list_contains(reasons, 'parse-gap') AS gap, struct_pack({', '.join(f'{c} := {c}' for c in dedup.ACCOUNTING)}) AS told,
    row_number() OVER (PARTITION BY key ORDER BY ordinal) AS rn FROM cp),
  fd AS (SELECT key, rn, ordinal, score, gap, told, false AS conflict FROM sc WHERE rn = 1 UNION ALL
    SELECT s.key, s.rn, CASE WHEN s.score < f.score THEN f.ordinal ELSE s.ordinal END, CASE WHEN s.score < f.score THEN f.score WHEN {_DIFFERS} THEN 50 + s.known ELSE s.score END,
      CASE WHEN s.score < f.score THEN f.gap ELSE s.gap OR {_DIFFERS} END, CASE WHEN s.score < f.score THEN f.told ELSE s.told END, CASE WHEN s.score < f.score THEN f.conflict ELSE {_DIFFERS} END
    FROM fd f JOIN sc s ON s.key = f.key AND s.rn = f.rn + 1)
  SELECT key, ordinal, CAST(score AS INTEGER) AS score, conflict FROM fd WHERE (key, rn) IN (SELECT key, max(rn) FROM sc GROUP BY key)""")
def d1_dedup_completeness(spark, sf):
    return dedup.by_arrival(_copies(spark, sf), ["key"], "ordinal").select("key", "ordinal", F.col("score").cast("int"), "conflict")


@query(f"WITH {USAGE_SQL}, {_COPIES} SELECT key, ordinal, session, at_ms FROM cp QUALIFY row_number() OVER (PARTITION BY key ORDER BY ordinal DESC) = 1")
def d2_last_wins(spark, sf):
    return dedup.last(_copies(spark, sf), "key", "ordinal").select("key", "ordinal", "session", "at_ms")


@query(f"""WITH {USAGE_SQL}, {_COPIES}, r AS (SELECT *, quality = 'recorded' AND total IS NOT NULL AS complete FROM cp)
SELECT key, arg_max_null(total, (complete, coalesce(at_ms, -1), ordinal)) AS total, bool_or(complete) AS complete, arg_min(session, ordinal) AS owner, min(at_ms) AS at_ms,
  count(DISTINCT struct_pack({', '.join(f'{c} := {c}' for c in usage.COUNTERS)})) FILTER (complete) > 1 AS conflict FROM r GROUP BY key""")
def d3_revision_select(spark, sf):
    r = _copies(spark, sf).withColumn("complete", (F.col("quality") == "recorded") & F.col("total").isNotNull())
    return dedup.revisions(r, "key", "at_ms", "ordinal", "complete", usage.COUNTERS)


@query(f"WITH {INPUTS_SQL} SELECT session, agent, kind, origin FROM inp QUALIFY row_number() OVER (PARTITION BY session, agent ORDER BY CASE kind WHEN 'submission' THEN 0 WHEN 'replay' THEN 2 ELSE 1 END, at_ms NULLS LAST, origin) = 1")
def d5_input_owner(spark, sf):
    order = F.when(F.col("kind") == "submission", 0).when(F.col("kind") == "replay", 2).otherwise(1)
    return dedup.best(views.inputs(spark, sf), ["session", "agent"], order, F.asc_nulls_last("at_ms"), F.asc("origin")).select("session", "agent", "kind", "origin")


_CHAIN = f"""{TURNS_SQL}, ch AS (SELECT conv_id, row_number() OVER w AS pos, string_agg(print, ',') OVER w AS upto, max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER w AS answered FROM tn WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


@query(f"""WITH {TURNS_SQL}, ch AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, string_agg(print, ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto FROM tn),
  gr AS (SELECT pos, upto, min(conv_id) AS first, count(*) AS members FROM ch GROUP BY ALL HAVING count(*) > 1), hi AS (SELECT conv_id, pos, first, members, row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS k FROM ch JOIN gr USING (pos, upto))
  SELECT conv_id, pos AS prefix, first, members FROM hi WHERE k = 1""")
def w7_prefix_len(spark, sf):
    return dedup.common_prefix(views.turns(spark, sf))


@query(f"WITH {_CHAIN}, ok AS (SELECT * FROM ch WHERE pos >= 2 AND answered = 1), own AS (SELECT pos, upto, min(conv_id) AS owner FROM ok GROUP BY ALL HAVING count(*) > 1) SELECT conv_id, arg_max(owner, pos) AS owner, max(pos) AS prefix FROM ok JOIN own USING (pos, upto) WHERE conv_id <> owner GROUP BY conv_id")
def d6_clone_prefix(spark, sf):
    return dedup.clones(views.turns(spark, sf))


@query(f"WITH {TURNS_SQL} SELECT print, count(*) AS copies, count(DISTINCT conv_id) AS sequences FROM tn GROUP BY print HAVING count(*) > 1")
def d7_ambiguous(spark, sf):
    return views.turns(spark, sf).groupBy("print").agg(F.count("*").alias("copies"), F.count_distinct("conv_id").alias("sequences")).filter("copies > 1")


@query(f"""WITH {USAGE_SQL}, {_COPIES}, mx AS (SELECT key, max(uncached) AS a, max(output) AS b, max(total) AS c FROM cp GROUP BY key),
m AS (SELECT key, ordinal, coalesce(uncached = a, true) AND coalesce(output = b, true) AND coalesce(total = c, true) AS dom FROM cp JOIN mx USING (key))
SELECT key, ordinal, NOT dom AS ambiguous FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY dom DESC, ordinal DESC) = 1""")
def d8_dominant_copy(spark, sf):
    return dedup.dominant(_copies(spark, sf), ["key"], ["uncached", "output", "total"], "ordinal").select("key", "ordinal", "ambiguous")


@query(f"WITH {USAGE_SQL} SELECT DISTINCT provider, model FROM us WHERE decision = 'included' ORDER BY ALL")
def d14_resources(spark, sf):
    return _included(spark, sf).select("provider", "model").distinct().orderBy("provider", "model")


@query(f"WITH {INPUTS_SQL}, cl AS (SELECT DISTINCT agent, session, CASE WHEN id % 2 = 0 THEN 'human' ELSE 'automated' END AS by_ FROM ev WHERE id % 5 = 0) SELECT agent, session, count(*) AS inputs, (SELECT count(DISTINCT by_) FROM cl WHERE cl.agent = inp.agent AND cl.session = inp.session) AS origins FROM inp WHERE (agent, session) IN (SELECT (agent, session) FROM cl) GROUP BY ALL")
def j2_claim_match(spark, sf):
    claims = views.events(spark, sf).filter("id % 5 = 0").select("agent", "session", F.when(F.col("id") % 2 == 0, "human").otherwise("automated").alias("by"))
    sides = claims.groupBy("agent", "session").agg(F.count_distinct("by").alias("origins"))
    return views.inputs(spark, sf).groupBy("agent", "session").agg(F.count("*").alias("inputs")).join(sides, ["agent", "session"])


@query(f"WITH {USAGE_SQL}, s AS (SELECT session, sum(total) AS t FROM us GROUP BY session), m AS (SELECT session, sum(total) AS t FROM us WHERE provider <> 'p3' AND origin % 2 = 0 GROUP BY session) SELECT session, CAST(s.t - coalesce(m.t, 0) AS BIGINT) AS rest FROM s LEFT JOIN m USING (session) WHERE s.t - coalesce(m.t, 0) > 0")
def a27_residual_counter(spark, sf):
    main = F.when((F.col("provider") != "p3") & (F.col("origin") % 2 == 0), F.col("total"))
    return views.usage(spark, sf).groupBy("session").agg((F.sum("total") - F.coalesce(F.sum(main), F.lit(0))).alias("rest")).filter("rest > 0")


# ---- sequences and lineage


@query(f"""WITH {COUNTERS_SQL}, b AS (SELECT *, lag(reading) OVER w AS before FROM ct WINDOW w AS (PARTITION BY counter ORDER BY at_ms, a, b)), r AS (SELECT *, CASE WHEN reading < before THEN 1 ELSE 0 END AS reset FROM b)
SELECT counter, epoch, count(*) AS readings, CAST(sum(delta) AS BIGINT) AS delta FROM (SELECT counter, CAST(sum(reset) OVER (PARTITION BY counter ORDER BY at_ms, a, b ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch, CASE WHEN before IS NULL THEN reading WHEN reset = 1 THEN 0 ELSE reading - before END AS delta FROM r) GROUP BY ALL""")
def w3_counter_delta(spark, sf):
    return sequences.counter_deltas(views.counters(spark, sf), "counter", "at_ms", "a", "b").groupBy("counter", "epoch").agg(F.count("*").alias("readings"), F.sum("delta").alias("delta"))


@query(f"WITH {USAGE_SQL}, s AS (SELECT *, CAST(sum(CASE WHEN origin % 10 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY at_ms, origin ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM us) SELECT session, segment, CASE WHEN count(total) = count(*) THEN CAST(sum(total) AS BIGINT) END AS value, count(*) AS records FROM s GROUP BY ALL")
def w4_checkpoint_segments(spark, sf):
    return sequences.segment_sums(views.usage(spark, sf).withColumn("mark", F.col("origin") % 10 == 0), "session", "mark", "total", "at_ms", "origin")


@query(f"WITH {USAGE_SQL} SELECT origin, last_value(CASE WHEN origin % 8 = 0 THEN CASE WHEN origin % 16 = 0 THEN 'unknown' ELSE model END END IGNORE NULLS) OVER (PARTITION BY session ORDER BY at_ms, origin ROWS UNBOUNDED PRECEDING) AS model FROM us")
def w5_forward_fill(spark, sf):
    u = views.usage(spark, sf)
    u = u.select("origin", "session", "at_ms", F.when(F.col("origin") % 8 == 0, F.struct(F.when(F.col("origin") % 16 != 0, F.col("model")).alias("model"))).alias("turn"))
    out = sequences.filled(u, "session", "turn", "at_ms", "origin")
    return out.select("origin", F.when(F.col("turn").isNotNull(), F.coalesce("turn.model", F.lit("unknown"))).alias("model"))


@query("WITH RECURSIVE n AS (SELECT event_id AS id, CASE WHEN event_id % 16 <> 0 THEN event_id // 2 END AS parent FROM events), up(id, at_, depth) AS (SELECT id, id, 0 FROM n UNION ALL SELECT up.id, p.id, depth + 1 FROM up JOIN n c ON c.id = up.at_ JOIN n p ON p.id = c.parent AND p.id <> c.id) SELECT id, arg_max(at_, depth) AS root, CAST(max(depth) AS BIGINT) AS depth FROM up GROUP BY id")
def g3_roots(spark, sf):
    from . import lineage

    ids = views.load(spark, sf, "events").select(F.col("event_id").alias("id"))
    return lineage.roots(ids.select("id", F.when((F.col("id") % 16 != 0) & (F.expr("id div 2") != F.col("id")), F.expr("id div 2")).alias("parent")))


@query("WITH RECURSIVE n AS (SELECT DISTINCT user_id AS id FROM events), e AS (SELECT DISTINCT user_id AS u, (user_id * 7) % 60 AS v FROM events WHERE user_id % 3 = 0 AND (user_id * 7) % 60 IN (SELECT id FROM n)), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e UNION SELECT id, id FROM n), r(id, c) AS (SELECT u, v FROM b UNION SELECT r.id, b.v FROM r JOIN b ON r.c = b.u) SELECT id, min(c) AS family FROM r GROUP BY id")
def g1_components(spark, sf):
    from . import lineage

    ids = views.load(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()
    edges = ids.filter("id % 3 = 0").select(F.col("id").alias("u"), (F.col("id") * 7 % 60).alias("v"))
    return lineage.families(ids, edges.join(ids.select(F.col("id").alias("v")), "v", "left_semi"))


# ---- change capture, quality, labels

_NEW = "nw AS (SELECT origin, CASE WHEN origin % 13 = 0 THEN at_ms + 86400000 ELSE at_ms END AS at_ms, CASE WHEN origin % 17 = 0 THEN total + 1 ELSE total END AS total FROM us WHERE origin % 19 <> 0)"
_DIRTY = f"""{USAGE_SQL}, {_NEW}, df AS (SELECT o.at_ms AS a, n.at_ms AS b FROM us o FULL JOIN nw n USING (origin) WHERE o.origin IS NULL OR n.origin IS NULL OR o.at_ms IS DISTINCT FROM n.at_ms OR o.total IS DISTINCT FROM n.total),
dt AS (SELECT DISTINCT CAST(DATE '1970-01-01' + CAST(x // 86400000 AS INTEGER) AS VARCHAR) AS day FROM (SELECT unnest([a, b]) AS x FROM df) WHERE x IS NOT NULL)"""


def _changed(spark, sf) -> tuple[DataFrame, DataFrame]:
    old = views.usage(spark, sf).select("origin", "at_ms", "total")
    moved = F.when(F.col("origin") % 13 == 0, F.col("at_ms") + 86_400_000).otherwise(F.col("at_ms"))
    return old, old.filter("origin % 19 <> 0").select("origin", moved.alias("at_ms"), F.when(F.col("origin") % 17 == 0, F.col("total") + 1).otherwise(F.col("total")).alias("total"))


@query(f"WITH {_DIRTY} SELECT day FROM dt")
def m7_dirty_days(spark, sf):
    return ledger.dirty_days(*_changed(spark, sf), "origin", "at_ms", ["total"])


@query(f"""WITH {WORK_SQL}, nw AS (SELECT origin, start_ms, CASE WHEN origin % 101 = 0 THEN end_ms + 172800000 WHEN origin % 7 = 0 THEN end_ms + 40000000 ELSE end_ms END AS end_ms FROM wk WHERE origin % 19 <> 0),
  df AS (SELECT unnest([struct_pack(a := o.start_ms, b := o.end_ms), struct_pack(a := n.start_ms, b := n.end_ms)]) AS x FROM wk o FULL JOIN nw n USING (origin) WHERE n.origin IS NULL OR o.end_ms IS DISTINCT FROM n.end_ms)
  SELECT DISTINCT CASE WHEN y = -1 THEN '*' ELSE CAST(DATE '1970-01-01' + CAST(y AS INTEGER) AS VARCHAR) END AS day FROM (
    SELECT unnest([x.a // 86400000, x.b // 86400000, CASE WHEN x.b // 86400000 - x.a // 86400000 > 1 THEN -1 END]) AS y FROM df) WHERE y IS NOT NULL""")
def m7_dirty_interval_days(spark, sf):
    old = views.work(spark, sf).select("origin", "start_ms", "end_ms")
    end = F.when(F.col("origin") % 101 == 0, F.col("end_ms") + 172_800_000).when(F.col("origin") % 7 == 0, F.col("end_ms") + 40_000_000).otherwise(F.col("end_ms"))
    return ledger.dirty_days(old, old.filter("origin % 19 <> 0").withColumn("end_ms", end), "origin", "start_ms", [], "end_ms")


@query(f"WITH {_DIRTY}, sp AS (SELECT CAST(unnest(generate_series({_LAST} - 364, {_LAST} - 1, INTERVAL 1 DAY)) AS DATE) AS d) SELECT CAST(d AS VARCHAR) AS date, EXISTS (SELECT 1 FROM dt WHERE abs(CAST(day AS DATE) - d) <= 1) AS stale FROM sp")
def m8_invalidated_days(spark, sf):
    days = _text(clock.spine(spark, CUTOFF_MS, ZONE, 365).filter(F.col("date") < clock.local_date(F.lit(CUTOFF_MS), ZONE)), "date").select("date")
    return ledger.invalidated(days, m7_dirty_days(spark, sf))


@query(f"WITH {USAGE_SQL} SELECT agent, CASE WHEN count(*) FILTER (quality = 'recorded') = count(*) THEN 'recorded' ELSE 'partial' END AS quality FROM us WHERE agent <> 'omp' OR quality = 'recorded' GROUP BY agent")
def q1_quality_rollup(spark, sf):
    return views.usage(spark, sf).filter("agent <> 'omp' or quality = 'recorded'").groupBy("agent").agg(quality.combined("quality").alias("quality"))


@query(f"WITH {USAGE_SQL} SELECT agent, coalesce(string_agg(DISTINCT r, ',' ORDER BY r), '') AS reasons FROM (SELECT agent, unnest(CASE WHEN len(reasons) = 0 THEN [NULL] ELSE reasons END) AS r FROM us) GROUP BY agent")
def u2_reason_union(spark, sf):
    return views.usage(spark, sf).groupBy("agent").agg(F.array_join(quality.all_reasons("reasons"), ",").alias("reasons"))


@query("""WITH lb AS (SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'https://x/' || user_id WHEN 1 THEN 'sk-' || event_id WHEN 2 THEN event_type || '/' || user_id WHEN 3 THEN '' WHEN 4 THEN '<b>' || event_type
  WHEN 5 THEN 'jo' || user_id || '@firm.example' WHEN 6 THEN 'GHO_' || event_id WHEN 7 THEN event_type || '(x)[' || user_id || ']' WHEN 8 THEN event_type || ' ' || user_id ELSE repeat(event_type, 30) END AS x FROM events)
SELECT event_id, CASE WHEN regexp_full_match(x, '[A-Za-z0-9._\\-/:+()\\[\\]]{1,128}') AND NOT contains(x, '://') AND NOT regexp_matches(lower(x), '^(sk-|ghp_|gho_|ghs_|github_pat_)') THEN x ELSE 'unknown' END AS label FROM lb""")
def p10_sanitize(spark, sf):
    e, m = views.load(spark, sf, "events"), F.col("event_id") % 10
    x = F.when(m == 0, F.concat(F.lit("https://x/"), "user_id")).when(m == 1, F.concat(F.lit("sk-"), "event_id")).when(m == 2, F.concat("event_type", F.lit("/"), "user_id")).when(m == 3, "").when(m == 4, F.concat(F.lit("<b>"), "event_type"))
    x = x.when(m == 5, F.concat(F.lit("jo"), "user_id", F.lit("@firm.example"))).when(m == 6, F.concat(F.lit("GHO_"), "event_id")).when(m == 7, F.concat("event_type", F.lit("(x)["), "user_id", F.lit("]")))
    x = x.when(m == 8, F.concat("event_type", F.lit(" "), "user_id")).otherwise(F.repeat("event_type", F.lit(30)))
    return e.select("event_id", quality.public_label(x).alias("label"))
