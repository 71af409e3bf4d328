"""Registered queries: filtered views, existence probes, look-ups by prefix, ranges put together from slots, revisions with all counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import dedup, usage
from . import catalog, views
from .catalog import _D, _LAST, _cut_off, _included, _SPINE, _SUMS, query
from .views import CUTOFF_MS, EVENTS_SQL, INPUTS_SQL, USAGE_SQL, WORK_SQL, ZONE


def filtered(facts: DataFrame, agents: DataFrame | None = None, resources: DataFrame | None = None) -> DataFrame:
    """Facts of the chosen agents and of the chosen (provider, model) pairs; a choice that isn't made leaves all."""
    if agents is not None:
        facts = facts.join(F.broadcast(agents.select("agent").distinct()), "agent", "left_semi")
    return facts if resources is None else facts.join(resources.select("provider", "model").distinct(), ["provider", "model"], "left_semi")


@query(f"""WITH {USAGE_SQL}, top AS (SELECT provider, model FROM us WHERE decision = 'included' GROUP BY ALL ORDER BY count(*) DESC, provider, model LIMIT 5)
SELECT CAST({_D} AS VARCHAR) AS date, count(*) AS records, {_SUMS} FROM us WHERE decision = 'included' AND agent <> 'omp' AND (provider, model) IN (SELECT (provider, model) FROM top) GROUP BY 1""")
def f6_filtered_view(spark, sf):
    """The daily view of all agents but one and of the five (provider, model) pairs with most records."""
    u = _included(spark, sf)
    top = u.groupBy("provider", "model").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "provider", "model").limit(5)
    return usage.sums(filtered(u, u.select("agent").distinct().filter("agent <> 'omp'"), top), "date")


@query(f"""WITH {USAGE_SQL}, {WORK_SQL.split('FROM events), ')[1]}, {INPUTS_SQL.split('FROM events), ')[1]}
SELECT agent, EXISTS (SELECT 1 FROM us WHERE us.agent = a.agent AND decision = 'included' AND at_ms <= {CUTOFF_MS}) AS has_usage, EXISTS (SELECT 1 FROM wk WHERE wk.agent = a.agent AND kind = 'tool') AS has_tools, EXISTS (SELECT 1 FROM inp WHERE inp.agent = a.agent AND kind = 'replay' AND at_ms IS NULL) AS has_undated_replays
FROM (SELECT DISTINCT agent FROM ev) a""")
def f8_existence(spark, sf):
    """For each agent whether any fact of a kind is there: semi-joins with keys made distinct before the shuffle."""
    some = lambda df, name: df.select("agent").distinct().withColumn(name, F.lit(True))
    a = views.events(spark, sf).select("agent").distinct()
    probes = {"has_usage": views.usage(spark, sf).filter(f"decision = 'included' and at_ms <= {CUTOFF_MS}"), "has_tools": views.work(spark, sf).filter("kind = 'tool'"), "has_undated_replays": views.inputs(spark, sf).filter("kind = 'replay' and at_ms is null")}
    for name, df in probes.items():
        a = a.join(some(df, name), "agent", "left")
    return a.fillna(False, list(probes))


def latest_by_prefix(state: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, rest, observed_ms) of the latest state key (the greatest of equals) that begins with each prefix.

    Keys are ``kind:source:id:print``; a prefix ends with a colon, so it is the key without its last part and the look-up is
    a join on equal texts, aggregated before it.
    """
    cut = F.length("key") - F.length(F.substring_index("key", ":", -1))
    keyed = state.select(F.substring("key", F.lit(1), cut).alias("prefix"), F.substring_index("key", ":", -1).alias("rest"), "observed_ms")
    return keyed.groupBy("prefix").agg(F.max(F.struct("observed_ms", "rest")).alias("x")).join(prefixes.select("prefix").distinct(), "prefix", "left_semi").select("prefix", "x.rest", "x.observed_ms")


@query("""WITH st AS (SELECT 'message-state:' || conv_id % 3 || ':' || conv_id || ':' || md5(role || turn % 4) AS key, 'message-state:' || conv_id % 3 || ':' || conv_id || ':' AS prefix, md5(role || turn % 4) AS rest, turn // 2 AS observed_ms, conv_id FROM conversations)
SELECT prefix, rest, observed_ms FROM st WHERE conv_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY observed_ms DESC, rest DESC) = 1""")
def f9_latest_print(spark, sf):
    c = views.load(spark, sf, "conversations")
    prefix = F.concat_ws(":", F.lit("message-state"), (F.col("conv_id") % 3).cast("string"), F.col("conv_id").cast("string"), F.lit(""))
    state = c.select(F.concat(prefix, F.md5(F.concat("role", (F.col("turn") % 4).cast("string")).cast("binary"))).alias("key"), F.expr("turn div 2").alias("observed_ms"))
    return latest_by_prefix(state, c.filter("conv_id % 2 = 0").select(prefix.alias("prefix")))


@query(f"""WITH {_SPINE}, sw AS ({_cut_off()}), rg AS (SELECT unnest([7, 30, 90, 365]) AS days),
hr AS (SELECT days, slot_end - slot_start AS ms, histogram, active_ms FROM sl LEFT JOIN sw USING (date, slot) JOIN rg ON CAST(sl.date AS DATE) > {_LAST} - CAST(days AS INTEGER)),
bn AS (SELECT days, CAST(string_split(b, ':')[1] AS BIGINT) AS lanes, CAST(string_split(b, ':')[2] AS BIGINT) AS ms FROM (SELECT days, unnest(string_split(histogram, ',')) AS b FROM hr WHERE histogram IS NOT NULL)),
hg AS (SELECT days, string_agg(lanes || ':' || ms, ',' ORDER BY lanes) AS histogram FROM (SELECT days, lanes, sum(ms) AS ms FROM bn GROUP BY ALL) GROUP BY days)
SELECT days, hg.histogram, CAST(sum(active_ms) AS BIGINT) AS active_ms, CAST(sum(CASE WHEN active_ms IS NULL THEN ms ELSE 0 END) AS BIGINT) AS unavailable_ms FROM hr JOIN hg USING (days) GROUP BY ALL""")
def a13_range_histograms(spark, sf):
    """Slots put together over the four ranges: sums of what is known, merged histograms, and how much is not."""
    last = clock.local_date(F.lit(CUTOFF_MS), ZONE)
    slots = catalog._text(clock.slots(clock.spine(spark, CUTOFF_MS, ZONE, 365)), "date")
    work = catalog.intervals.clip(catalog._fan(spark, sf), F.col("start_ms"), F.lit(CUTOFF_MS))
    level = catalog.intervals.levels(work, ["date", "slot"], catalog.LANE)
    ranges = F.broadcast(spark.createDataFrame([(d,) for d in (7, 30, 90, 365)], "days int"))
    within = lambda df: df.join(ranges, F.to_date("date") > F.date_sub(last, F.col("days")))
    known = level.groupBy("date", "slot").agg(F.sum("ms").alias("active_ms"))
    sums = within(slots.join(known, ["date", "slot"], "left")).groupBy("days").agg(F.sum("active_ms").alias("active_ms"), F.sum(F.when(F.col("active_ms").isNull(), F.col("slot_end") - F.col("slot_start")).otherwise(0)).alias("unavailable_ms"))
    bins = within(level.join(slots.select("date", "slot"), ["date", "slot"], "left_semi")).groupBy("days", "lanes").agg(F.sum("ms").alias("ms"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lanes", "ms"))), lambda x: F.concat_ws(":", x["lanes"], x["ms"])), ",")
    return bins.groupBy("days").agg(text.alias("histogram")).join(sums, "days")


_R = ", ".join(usage.COUNTERS)


@query(f"""WITH {USAGE_SQL}, {catalog._COPIES}, r AS (SELECT *, quality = 'recorded' AND total IS NOT NULL AS complete, session % 7 AS file_ms, 'f' || session % 13 AS path FROM cp)
SELECT key, {_R}, complete, owner, first_ms AS at_ms, conflict FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY complete DESC, coalesce(at_ms, -1) DESC, ordinal DESC) AS k FROM r)
JOIN (SELECT key, arg_min(session, (file_ms, path, ordinal)) AS owner, min(at_ms) AS first_ms, count(DISTINCT struct_pack({', '.join(f'{c} := {c}' for c in usage.COUNTERS)})) FILTER (complete) > 1 AS conflict FROM r GROUP BY key) USING (key) WHERE k = 1""")
def d3_revision_counters(spark, sf):
    """Of a response's revisions the chosen one with all its counters; the owner is the earliest file's."""
    r = catalog._copies(spark, sf).withColumns({"complete": (F.col("quality") == "recorded") & F.col("total").isNotNull(), "file_ms": F.col("session") % 7, "path": F.concat(F.lit("f"), (F.col("session") % 13).cast("string"))})
    return dedup.chosen_revision(r, "key", "at_ms", ("ordinal",), ("file_ms", "path", "ordinal"), "complete", usage.COUNTERS)
