"""The public document of 13 keys: put together from aggregates, loaded strictly, checked against its own rules, written staged.

``DOCUMENT`` is the whole shape. A text is a document only if parsing it by that shape and writing it again gives the same
content: a key too many, a key too few or a value of another type would not come back. ``violations`` then tells which
rules hold between values. Days, hours and labels are bounded, so one document is one row; its parts are aggregated by
Spark before they are nested.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fields, pricing, quality
from ..functions.quality import CEILING, REASONS
from ..operators import inputs, intervals, kinds, usage

#: The version, agents in their order, qualities, states and ranges of the public document.
VERSION = 6
AGENTS = ("codex", "claude", "omp", "opencode", "hermes")
QUALITIES = ("recorded", "partial", "unavailable")
STATES = ("available", "partial", "not-found", "installed-no-history", "excluded-wrapper", "unsupported-schema")
RANGES = (7, 30, 90, 365)
TOKENS = {"total": "total", "uncachedInput": "uncached", "cacheRead": "cache_read", "cacheWrite": "cache_write", "output": "output", "reasoning": "reasoning", "otherRecorded": "other"}
EXCLUDED = {"context": "context", "replayed": "replay", "unknownKind": "unknown-kind", "subagent": "subagent", "unknownLane": "unknown-lane", "undated": "undated"}
COHORT = {"inputHistory": "input-history", "mixedScope": "mixed-scope", "noRecordedWork": "no-recorded-work"}
DECISIONS = {"included": "included", "outOfScope": "out-of-scope", "unattributed": "unattributed"}


def _struct(**fields_: str) -> str:
    return "struct<" + ", ".join(f"`{k}`: {t}" for k, t in fields_.items()) + ">"


def _counts(*names: str) -> str:
    return _struct(**dict.fromkeys(names, "bigint"))


def _metric(value: str) -> str:
    return _struct(value=value, status="string", reasons="array<string>")


_USAGE = _struct(**dict.fromkeys(TOKENS, _metric("bigint")), cacheReadBasis=_metric(_counts("readTokens", "promptTokens")))
_COST = _struct(apiEquivalentUsd=_metric("double"), pricedRecords="bigint", unpricedRecords="bigint", pricedTokens="bigint", unpricedTokens="bigint", sourceEstimatedUsd=_metric("double"), providerReportedUsd=_metric("double"), unknownRecords="bigint", includedRecords="bigint")
_WORK = _metric(_struct(activeMs="bigint", inferenceMs="bigint", agentMs="bigint", parallelMs="bigint", histogram=f"array<{_counts('agents', 'elapsedMs')}>", unavailableMs="bigint"))
_WORKS = _struct(work=_WORK, byHarness=f"array<{_struct(harness='string', work=_WORK)}>")
_GROUP = _struct(inputs=_metric(_counts("inputs", "activeSessions")), cadence=_metric(_counts("sessions", "inputs", "recordedWorkMs")), cadenceCoverage=_struct(consideredSessions="bigint", excluded=_counts(*COHORT)), excluded=_counts(*EXCLUDED))
_RANGE = _struct(all=_GROUP, byHarness=f"array<{_struct(harness='string', group=_GROUP)}>")
_SCOPE = _struct(byHarness=f"array<{_struct(harness='string', **dict.fromkeys(DECISIONS, _counts('records', 'knownTokens', 'unknownTotalRecords')))}>")
_DAY = _struct(date="string", elapsedMs="bigint", usage=_USAGE, cost=_COST, usageRows=f"array<{_struct(harness='string', provider='string', model='string', usage=_USAGE, cost=_COST)}>", work=_WORKS, hours=f"array<{_struct(start='string', elapsedMs='bigint', work=_WORKS)}>", commits=_metric("bigint"), scope=_SCOPE)
DOCUMENT = _struct(
    schemaVersion="bigint", pricing=_struct(asOf="string", basis="string", sources="array<string>"), organization="string", timezone="string", generatedAt="string", cutoff="string", periodStart="string", periodEnd="string",
    collectionStatus="string", sources=f"array<{_struct(agent='string', state='string', tokens='string', work='string', reasons='array<string>')}>",
    coverage=_struct(unallocatedUsageRecords="bigint", excludedAmbiguousRecords="bigint", scopeStatus="string", undated=_SCOPE), inputRanges=_struct(**{str(r): _RANGE for r in RANGES}), days=f"array<{_DAY}>",
)


# ---- strict load


def parsed(texts: DataFrame) -> DataFrame:
    """``texts`` (text) with ``document``, null for what isn't one in every key and type."""
    t = texts.withColumn("_d", F.from_json("text", DOCUMENT))
    again = F.to_json("_d", {"ignoreNullFields": "false"})
    same = kinds.content_print(again) == kinds.content_print(F.col("text"))
    return t.withColumn("document", F.when(same & (F.col("_d.schemaVersion") == VERSION), F.col("_d"))).drop("_d")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The document in a file as one row of its columns; raises if it isn't one or breaks a rule."""
    found = parsed(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")).filter("document is not null").select("document.*")
    if found.isEmpty():
        raise ValueError("not a public document")
    broken = violations(found).select("rule").distinct().limit(20).collect()
    if broken:
        raise ValueError("rules broken: " + ", ".join(sorted(r.rule for r in broken)))
    return found


# ---- rules


def _all(checks: list[tuple[str, Column]]) -> Column:
    """The rules that don't hold; what is unknown doesn't."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), rule) for rule, ok in checks]))


def _told(m: Column, counts: Column | None = None) -> list[tuple[str, Column]]:
    r = m["reasons"]
    rows = [("status", m["status"].isin(*QUALITIES)), ("reasons", (F.size(F.array_except(r, F.array(*map(F.lit, REASONS)))) == 0) & (r == F.array_sort(F.array_distinct(r))))]
    return rows + ([("counts", counts)] if counts is not None else [])


def _count(*x: Column) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(c.between(0, CEILING), F.lit(False)) for c in x])


def _or_null(m: Column, ok: Column) -> Column:
    return m["value"].isNull() | ok


def _usage_rules(u: Column) -> list[tuple[str, Column]]:
    basis = u["cacheReadBasis"]
    return [c for k in TOKENS for c in _told(u[k], _or_null(u[k], _count(u[k]["value"])))] + _told(basis, _or_null(basis, _count(basis["value"]["readTokens"], basis["value"]["promptTokens"])))


def _cost_rules(c: Column) -> list[tuple[str, Column]]:
    money = [x for k in ("apiEquivalentUsd", "sourceEstimatedUsd", "providerReportedUsd") for x in _told(c[k], _or_null(c[k], c[k]["value"].between(0, CEILING)))]
    return [*money, ("counts", _count(*[c[k] for k in ("pricedRecords", "unpricedRecords", "pricedTokens", "unpricedTokens", "unknownRecords", "includedRecords")]))]


def _ordered(names: Column) -> Column:
    """Agents, each once, in their order."""
    place = F.transform(names, lambda n: F.array_position(F.array(*map(F.lit, AGENTS)), n))
    return (F.size(F.filter(place, lambda p: p == 0)) == 0) & (place == F.array_sort(F.array_distinct(place)))


def _work_rules(w: Column) -> list[tuple[str, Column]]:
    v = w["value"]
    agents = F.transform(v["histogram"], lambda h: h["agents"])
    bins = F.forall(v["histogram"], lambda h: _count(h["agents"]) & h["elapsedMs"].between(1, CEILING)) & (agents == F.array_sort(F.array_distinct(agents)))
    return [*_told(w, _or_null(w, _count(*[v[k] for k in ("activeMs", "inferenceMs", "agentMs", "parallelMs", "unavailableMs")]))), ("inference-in-active", _or_null(w, v["inferenceMs"] <= v["activeMs"])), ("histogram", _or_null(w, bins))]


def _group_rules(g: Column) -> list[tuple[str, Column]]:
    i, c, cover = g["inputs"], g["cadence"], g["cadenceCoverage"]
    n, m = i["value"], c["value"]
    said = lambda x: x["value"].isNull() == (x["status"] == "unavailable")
    left = reduce(lambda a, b: a + b, [cover["excluded"][k] for k in COHORT])
    zero = F.lit(0)
    return [
        *_told(i, _or_null(i, _count(n["inputs"], n["activeSessions"]))), *_told(c, _or_null(c, _count(m["sessions"], m["inputs"], m["recordedWorkMs"]))), ("counts", _count(cover["consideredSessions"], *[cover["excluded"][k] for k in COHORT], *[g["excluded"][k] for k in EXCLUDED])),
        ("availability", said(i) & said(c)), ("inputs", _or_null(i, (n["inputs"] >= n["activeSessions"]) & ((n["inputs"] == 0) == (n["activeSessions"] == 0)))),
        ("cadence", _or_null(c, (m["sessions"] > 0) & (m["inputs"] >= m["sessions"]) & (m["recordedWorkMs"] > 0) & F.coalesce((m["inputs"] <= n["inputs"]) & (m["sessions"] <= n["activeSessions"]), F.lit(False)))),
        ("considered", (cover["consideredSessions"] == F.coalesce(n["activeSessions"], zero)) & (F.coalesce(m["sessions"], zero) + left == cover["consideredSessions"])),
    ]


def _range_rules(r: Column) -> list[tuple[str, Column]]:
    each, whole = F.transform(r["byHarness"], lambda x: x["group"]), r["all"]
    total = lambda f: F.aggregate(each, F.lit(0).cast("long"), lambda a, g: a + F.coalesce(f(g), F.lit(0)))
    some = lambda f: F.exists(each, lambda g: f(g).isNotNull())
    sums = [(lambda g, k=k: g["inputs"]["value"][k]) for k in ("inputs", "activeSessions")] + [(lambda g, k=k: g["cadence"]["value"][k]) for k in ("sessions", "inputs", "recordedWorkMs")] + [lambda g: g["cadenceCoverage"]["consideredSessions"]]
    sums += [(lambda g, k=k: g["cadenceCoverage"]["excluded"][k]) for k in COHORT] + [(lambda g, k=k: g["excluded"][k]) for k in EXCLUDED]
    there = [whole[k]["value"].isNotNull() == some(lambda g, k=k: g[k]["value"]) for k in ("inputs", "cadence")]
    return [("harness-order", _ordered(F.transform(r["byHarness"], lambda x: x["harness"]))), ("harness-sums", reduce(lambda a, b: a & b, [*there, *[F.coalesce(f(whole), F.lit(0)) == total(f) for f in sums]]))]


def _scope_rules(s: Column) -> list[tuple[str, Column]]:
    one = lambda c: _count(c["records"], c["knownTokens"], c["unknownTotalRecords"]) & (c["unknownTotalRecords"] <= c["records"])
    return [("scope", F.forall(s["byHarness"], lambda h: h["harness"].isin(*AGENTS) & reduce(lambda a, b: a & b, [one(h[k]) for k in DECISIONS])))]


def violations(documents: DataFrame) -> DataFrame:
    """(place, rule) of every rule that a document breaks."""
    day = r"^\d{4}-\d{2}-\d{2}\z"
    date = lambda c: c.rlike(day) & F.try_to_timestamp(c).isNotNull()
    instant = lambda c: c.rlike(r"^\d{4}-\d{2}-\d{2}T.*(Z|[+-]\d{2}:\d{2})\z") & F.try_to_timestamp(c).isNotNull()
    d = documents
    col = F.col
    places = F.forall("pricing.sources", lambda u: u.rlike(r"^https://[^/@\s]+(/\S*)?\z"))
    source = lambda s: s["agent"].rlike(r"^[A-Za-z0-9._-]{1,64}\z") & s["state"].isin(*STATES) & s["tokens"].isin(*QUALITIES) & s["work"].isin(*QUALITIES) & (s["reasons"] == F.array_sort(F.array_distinct(s["reasons"]))) & (F.size(F.array_except(s["reasons"], F.array(*map(F.lit, REASONS)))) == 0)
    top = [
        ("version", col("schemaVersion") == VERSION), ("pricing", date(col("pricing.asOf")) & (col("pricing.basis") == "standard-api") & places), ("organization", F.length("organization").between(1, 80) & (F.trim("organization") == col("organization"))),
        ("timezone", F.length("timezone").between(1, 128)), ("instants", instant(col("generatedAt")) & instant(col("cutoff"))), ("period", date(col("periodStart")) & date(col("periodEnd"))), ("collection", col("collectionStatus").isin("ok", "partial")),
        ("sources", F.forall("sources", source)), ("coverage", _count(col("coverage.unallocatedUsageRecords"), col("coverage.excludedAmbiguousRecords")) & col("coverage.scopeStatus").isin(*QUALITIES)), *_scope_rules(col("coverage.undated")),
    ]
    told = lambda df, place, checks: df.select(place.alias("place"), F.explode(_all(checks)).alias("rule"))
    out = [told(d, F.lit("document"), top)]
    ranges = d.select(F.explode(F.array(*[F.struct(F.lit(str(r)).alias("name"), col(f"inputRanges.`{r}`").alias("r")) for r in RANGES])).alias("x")).select("x.*")
    out += [told(ranges, F.concat(F.lit("range "), "name"), _range_rules(col("r")))]
    groups = ranges.select("name", F.explode(F.concat(F.array("r.all"), F.transform("r.byHarness", lambda x: x["group"]))).alias("g"))
    out += [told(groups, F.concat(F.lit("range "), "name"), _group_rules(col("g")))]
    days = d.select(F.explode("days").alias("day"))
    at = col("day.date")
    out += [told(days, at, [("date", date(at)), ("counts", _count(col("day.elapsedMs"))), *_usage_rules(col("day.usage")), *_cost_rules(col("day.cost")), *_told(col("day.commits"), _or_null(col("day.commits"), _count(col("day.commits.value")))), *_scope_rules(col("day.scope"))])]
    rows = days.select(at.alias("date"), F.explode("day.usageRows").alias("r"))
    safe = lambda c: quality.public_label(c) == c
    out += [told(rows, col("date"), [("harness-order", col("r.harness").isin(*AGENTS)), ("label", safe(col("r.provider")) & safe(col("r.model"))), *_usage_rules(col("r.usage")), *_cost_rules(col("r.cost"))])]
    hours = days.select(at.alias("date"), F.explode("day.hours").alias("h"))
    out += [told(hours, col("date"), [("hour", instant(col("h.start")) & _count(col("h.elapsedMs")))])]
    works = days.select(at.alias("date"), F.explode(F.concat(F.array("day.work"), F.transform("day.hours", lambda h: h["work"]))).alias("w"))
    out += [told(works, col("date"), [("harness-order", _ordered(F.transform("w.byHarness", lambda x: x["harness"])))])]
    stats = works.select("date", F.explode(F.concat(F.array("w.work"), F.transform("w.byHarness", lambda x: x["work"]))).alias("w"))
    out += [told(stats, col("date"), _work_rules(col("w")))]
    return reduce(DataFrame.unionByName, out)


# ---- assembly


def _as_metric(value: Column, status: Column, reasons: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(value.alias("value"), status.alias("status"), F.when(status == "recorded", none).otherwise(reasons).alias("reasons"))


def usage_and_cost(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, usage, cost) of priced usage in one aggregation."""
    prompt = F.col("uncached") + F.col("cache_read") + F.col("cache_write")
    ok, tokens = F.col("why_unpriced").isNull(), F.coalesce("total", F.lit(0))
    of = lambda kind: F.sum(F.when(F.col("cost_kind") == kind, F.col("cost_micro")))
    nano = F.sum(F.col("nano_usd").cast("decimal(38,0)"))
    rows = rows.withColumn("_other", usage._residual())
    g = rows.groupBy(*keys).agg(
        *[c for name in usage.COUNTERS for c in quality.known_sum(name, name)], *quality.known_sum("_other", "other"), F.sum(F.when(prompt.isNotNull(), F.col("cache_read"))).alias("read"), F.sum(prompt).alias("prompt"), F.count(prompt).alias("paired"), F.count("*").alias("n"),
        F.count_if(ok).alias("priced"), F.count_if(~ok).alias("unpriced"), F.coalesce(F.sum(F.when(ok, tokens)), F.lit(0)).alias("priced_tokens"), F.coalesce(F.sum(F.when(~ok, tokens)), F.lit(0)).alias("unpriced_tokens"), nano.alias("nano"), F.array_compact(F.array_sort(F.collect_set("why_unpriced"))).alias("why"),
        of("source-estimate").alias("estimated"), of("provider-reported").alias("reported"), F.count_if(F.col("cost_kind") == "unknown").alias("unknown"), F.count_if(F.col("cost_kind") == "included").alias("included"), quality.all_reasons("reasons").alias("codes"),
    )
    codes = fields.relevant(F.col("codes"), fields.TIMING)
    some = F.coalesce(F.col("prompt") > 0, F.lit(False))
    basis = _as_metric(F.when(some, F.struct(F.col("read").alias("readTokens"), F.col("prompt").alias("promptTokens"))), F.when(~some, "unavailable").when(F.col("paired") == F.col("n"), "recorded").otherwise("partial"), codes)
    money = lambda x, scale: (x / scale).cast("double")
    known = lambda x: F.when(x.isNull(), "unavailable").when(F.col("unknown") > 0, "partial").otherwise("recorded")
    priced = F.when(F.col("priced") == 0, "unavailable").when(F.col("unpriced") > 0, "partial").otherwise("recorded")
    none = F.array().cast("array<string>")
    cost = F.struct(
        _as_metric(F.when(F.col("priced") > 0, money(F.col("nano"), 1e9)), priced, F.col("why")).alias("apiEquivalentUsd"), F.col("priced").alias("pricedRecords"), F.col("unpriced").alias("unpricedRecords"), F.col("priced_tokens").alias("pricedTokens"), F.col("unpriced_tokens").alias("unpricedTokens"),
        *[_as_metric(money(F.col(c), 1e6), known(F.col(c)), none).alias(name) for c, name in (("estimated", "sourceEstimatedUsd"), ("reported", "providerReportedUsd"))], F.col("unknown").alias("unknownRecords"), F.col("included").alias("includedRecords"),
    )
    told = F.struct(*[_as_metric(F.col(c), F.col(f"{c}_status"), codes).alias(k) for k, c in TOKENS.items()], basis.alias("cacheReadBasis"))
    return g.select(*keys, told.alias("usage"), cost.alias("cost"))


def work_of(slots: DataFrame, keys: list[str], lane: list[str]) -> DataFrame:
    """(keys, stats): work of fanned-out intervals in each key, without idle time."""
    level = intervals.levels(slots, keys, lane).groupBy(*keys).agg(F.sum("ms").alias("active"), F.sum(F.col("ms") * F.col("lanes")).alias("agent_ms"), F.coalesce(F.sum(F.when(F.col("lanes") > 1, F.col("ms"))), F.lit(0)).alias("parallel"), F.array_sort(F.collect_list(F.struct(F.col("lanes").cast("bigint").alias("agents"), F.col("ms").alias("elapsedMs")))).alias("bins"))
    inference = intervals.levels(slots.filter("kind = 'inference'"), keys, lane).groupBy(*keys).agg(F.sum("ms").alias("inference"))
    return level.join(inference, keys, "left").withColumn("inference", F.coalesce("inference", F.lit(0)))


def _stats(elapsed: Column, ok: Column, reasons: Column) -> Column:
    """The metric of a slot or day with columns active, inference, agent_ms, parallel and bins; ``ok``: what isn't there is known to be none."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    idle = elapsed - zero("active")
    empty = F.array().cast("array<struct<agents: bigint, elapsedMs: bigint>>")
    bins = F.concat(F.when(idle > 0, F.array(F.struct(F.lit(0).cast("long").alias("agents"), idle.alias("elapsedMs")))).otherwise(empty), F.coalesce("bins", empty))
    there = F.col("active").isNotNull() | ok
    value = F.struct(zero("active").alias("activeMs"), zero("inference").alias("inferenceMs"), zero("agent_ms").alias("agentMs"), zero("parallel").alias("parallelMs"), bins.alias("histogram"), F.lit(0).cast("long").alias("unavailableMs"))
    return _as_metric(F.when(there, value), F.when(there, "recorded").otherwise("unavailable"), reasons)


def _nested(df: DataFrame, key: list[str], name: str, order: tuple[str, ...], made: Column) -> DataFrame:
    """One array of structs for each key, ordered; the arrays are as long as there are hours, agents or labels."""
    rows = df.select(*key, F.struct(*[F.col(o) for o in order], made.alias("x")).alias("r"))
    return rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list("r"), lambda a, b: _before(a, b, order)), lambda r: r["x"]).alias(name))


def _before(a: Column, b: Column, order: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for o in reversed(order):
        out = F.when(a[o] < b[o], -1).when(a[o] > b[o], 1).otherwise(out)
    return out


def place(agent: str = "agent") -> Column:
    return F.array_position(F.array(*map(F.lit, AGENTS)), F.col(agent))


def days(spine: DataFrame, slots: DataFrame, facts: DataFrame, work: DataFrame, commits: DataFrame, zone: str) -> DataFrame:
    """(date, day) of each spine day.

    ``spine``: date, start_ms, end_ms; ``slots``: date, slot, slot_start, slot_end; ``facts``: usage with agent, date and
    decision; ``work``: intervals cut to the period; ``commits``: date, commits.
    """
    priced = pricing.priced(facts.filter("decision = 'included'"))
    none = F.array(F.lit("missing-source"))
    fan = intervals.fan_out(work, zone)
    first = fan.agg(F.min("date").alias("first"))  # one row
    hours = slots.select("date", "slot", F.col("slot_start"), (F.col("slot_end") - F.col("slot_start")).alias("elapsed")).crossJoin(F.broadcast(first)).withColumn("ok", F.coalesce(F.col("date") >= F.col("first"), F.lit(False)))
    lanes = ["agent", "session"]
    stamp = F.date_format(F.timestamp_millis("slot_start"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    levels = {"hour": ["date", "slot"], "day": ["date"]}
    made = {}
    for name, keys in levels.items():
        base = hours.select(*keys, "elapsed", "ok", "slot_start") if name == "hour" else hours.groupBy("date").agg(F.sum("elapsed").alias("elapsed"), F.bool_and("ok").alias("ok"), F.min("slot_start").alias("slot_start"))
        # A day's levels are those of its hours put together, as hours don't overlap.
        whole = _rolled(work_of(fan, ["date", "slot"], lanes), keys)
        each = _rolled(work_of(fan, ["date", "slot", "agent"], ["session"]), [*keys, "agent"]).join(base, keys)
        each = _nested(each.withColumn("p", place()), keys, "byHarness", ("p",), F.struct(F.col("agent").alias("harness"), _stats(F.col("elapsed"), F.lit(True), none).alias("work")))
        j = base.join(whole, keys, "left").join(each, keys, "left")
        empty = F.array().cast(f"array<{_struct(harness='string', work=_WORK)}>")
        made[name] = j.select(*keys, "elapsed", "slot_start", F.struct(_stats(F.col("elapsed"), F.col("ok"), none).alias("work"), F.coalesce("byHarness", empty).alias("byHarness")).alias("work"))
    hourly = _nested(made["hour"], ["date"], "hours", ("slot",), F.struct(stamp.alias("start"), F.col("elapsed").alias("elapsedMs"), F.col("work").alias("work")))
    daily = usage_and_cost(priced, "date")
    labels = priced.withColumns({"provider": quality.public_label(F.col("provider")), "model": quality.public_label(F.col("model"))})
    rows = usage_and_cost(labels, "date", "agent", "provider", "model").withColumn("p", place())
    rows = _nested(rows, ["date"], "usageRows", ("p", "provider", "model"), F.struct(F.col("agent").alias("harness"), "provider", "model", "usage", "cost"))
    scope = scope_of(facts, "date")
    out = spine.select("date").join(made["day"].select("date", "elapsed", "work"), "date").join(hourly, "date").join(daily, "date", "left").join(rows, "date", "left").join(scope, "date", "left").join(commits, "date", "left")
    lost = lambda kind: _as_metric(F.lit(None).cast(kind), F.lit("unavailable"), none)
    no_usage = F.struct(*[lost("bigint").alias(k) for k in TOKENS], lost(_counts("readTokens", "promptTokens")).alias("cacheReadBasis"))
    zero = F.lit(0).cast("long")
    no_cost = F.struct(lost("double").alias("apiEquivalentUsd"), *[zero.alias(k) for k in ("pricedRecords", "unpricedRecords", "pricedTokens", "unpricedTokens")], lost("double").alias("sourceEstimatedUsd"), lost("double").alias("providerReportedUsd"), zero.alias("unknownRecords"), zero.alias("includedRecords"))
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    row = _struct(harness="string", provider="string", model="string", usage=_USAGE, cost=_COST)
    there = F.col("usage").isNotNull()
    return out.select("date", F.struct(
        F.col("date").cast("string").alias("date"), F.col("elapsed").alias("elapsedMs"), F.when(there, F.col("usage").cast(_USAGE)).otherwise(no_usage.cast(_USAGE)).alias("usage"), F.when(there, F.col("cost").cast(_COST)).otherwise(no_cost.cast(_COST)).alias("cost"),
        F.coalesce(F.col("usageRows").cast(f"array<{row}>"), empty(row)).alias("usageRows"), F.col("work").cast(_WORKS).alias("work"), "hours", _as_metric(F.coalesce("commits", zero), F.lit("recorded"), none).alias("commits"),
        F.coalesce("scope", F.struct(empty(_SCOPE[len("struct<`byHarness`: array<") : -2]).alias("byHarness"))).alias("scope"),
    ).cast(_DAY).alias("day"))


def _rolled(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Hourly stats (date, slot, ...) summed over ``keys``; histograms are merged by their bins."""
    if "slot" in keys:
        return stats
    bins = stats.select(*keys, F.explode("bins").alias("b")).groupBy(*keys, "b.agents").agg(F.sum("b.elapsedMs").alias("ms"))
    merged = bins.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("agents", F.col("ms").alias("elapsedMs")))).alias("bins"))
    return stats.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("active", "agent_ms", "parallel", "inference")]).join(merged, keys)


def scope_of(facts: DataFrame, *keys: str) -> DataFrame:
    """(keys, scope): records and tokens by agent and decision."""
    of = lambda d: F.struct(F.count_if(d).alias("records"), F.coalesce(F.sum(F.when(d, F.col("total"))), F.lit(0)).alias("knownTokens"), F.count_if(d & F.col("total").isNull()).alias("unknownTotalRecords"))
    each = facts.groupBy(*keys, "agent").agg(*[of(F.col("decision") == d).alias(k) for k, d in DECISIONS.items()]).withColumn("p", place())
    return _nested(each, list(keys), "harnesses", ("p",), F.struct(F.col("agent").alias("harness"), *DECISIONS)).select(*keys, F.struct(F.col("harnesses").alias("byHarness")).alias("scope"))


def input_ranges(observed: DataFrame, states: DataFrame, work: DataFrame, ranges: DataFrame, zone: str) -> DataFrame:
    """(days, range): the input groups of each range, by agent and of all, whose numbers are the agents' sums."""
    pop = inputs.population(inputs.ranged(observed, ranges), "days", "agent")
    n = lambda o: F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("inputs"))), F.lit(0))
    pop = pop.groupBy("days", "agent").agg(n("counted").alias("inputs"), F.coalesce(F.sum(F.when(F.col("outcome") == "counted", F.col("sessions"))), F.lit(0)).alias("active"), *[n(o).alias(k) for k, o in EXCLUDED.items()])
    cad = inputs.cadence(observed, states, work, ranges, zone, "agent")
    m = lambda s, c: F.coalesce(F.sum(F.when(F.col("state") == s, F.col(c))), F.lit(0))
    cad = cad.groupBy("days", "agent").agg(m("measured", "sessions").alias("sessions"), m("measured", "inputs").alias("measured"), m("measured", "work_ms").alias("ms"), *[m(s, "sessions").alias(k) for k, s in COHORT.items()])
    vague = observed.filter("decision = 'included'").groupBy("agent").agg(F.bool_or((F.col("quality") != "recorded") | (F.col("kind") == "unknown") | (F.col("lane") == "unknown") | (F.col("at_ms").isNull() & ~F.col("kind").isin("context", "replay"))).alias("vague"))
    numbers = ["inputs", "active", *EXCLUDED, "sessions", "measured", "ms", *COHORT]
    each = pop.join(cad, ["days", "agent"], "left").join(vague, "agent", "left").fillna(0, numbers).withColumn("p", place())
    every = each.groupBy("days").agg(*[F.sum(c).alias(c) for c in numbers], F.bool_or("vague").alias("vague"))
    some = F.array(F.lit("input-history-incomplete"))
    left = F.col("inputHistory") + F.col("mixedScope") + F.col("noRecordedWork")
    gap = F.coalesce("vague", F.lit(False))
    codes = F.array_compact(F.array(F.when(gap | (F.col("inputHistory") + F.col("mixedScope") > 0), "input-history-incomplete"), F.when(F.col("noRecordedWork") > 0, "timing-unavailable")))
    group = F.struct(
        _as_metric(F.struct(F.col("inputs"), F.col("active").alias("activeSessions")), F.when(gap, "partial").otherwise("recorded"), some).alias("inputs"),
        _as_metric(F.when(F.col("sessions") > 0, F.struct("sessions", F.col("measured").alias("inputs"), F.col("ms").alias("recordedWorkMs"))), F.when(F.col("sessions") == 0, "unavailable").when(gap | (left > 0), "partial").otherwise("recorded"), codes).alias("cadence"),
        F.struct(F.col("active").alias("consideredSessions"), F.struct(*COHORT).alias("excluded")).alias("cadenceCoverage"), F.struct(*EXCLUDED).alias("excluded"),
    )
    by = _nested(each, ["days"], "byHarness", ("p",), F.struct(F.col("agent").alias("harness"), group.alias("group")))
    return every.select("days", group.alias("all")).join(by, "days").select("days", F.struct("all", "byHarness").cast(_RANGE).alias("range"))


def assembled(days_: DataFrame, ranges_: DataFrame, sources: DataFrame, undated: DataFrame, told: dict[str, object]) -> DataFrame:
    """The one row of a document. ``days_`` and ``ranges_`` as above, ``sources``: agent, state, tokens, work, reasons; ``undated``: usage without a time; ``told``: what is given."""
    day = days_.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("date").cast("string").alias("date"), "day"))), lambda x: x["day"]).alias("days"))  # as many as a year has
    by = ranges_.agg(*[F.max_by("range", F.when(F.col("days") == r, 1)).alias(str(r)) for r in RANGES])
    said = sources.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce(place(), F.lit(0)).alias("p"), "agent", "state", "tokens", "work", "reasons"))), lambda s: F.struct(*[s[c].alias(c) for c in ("agent", "state", "tokens", "work", "reasons")])).alias("sources"), F.bool_and((F.col("state") == "available") & (F.col("tokens") == "recorded") & (F.col("work") == "recorded")).alias("whole"))
    scope = scope_of(undated.withColumn("one", F.lit(1)), "one").select("scope")
    lit = lambda k: F.lit(told[k])
    none = F.from_json(F.lit('{"byHarness": []}'), _SCOPE)
    one = day.crossJoin(F.broadcast(by)).crossJoin(F.broadcast(said)).join(F.broadcast(scope), F.lit(True), "left")  # one row each
    return one.select(F.struct(
        F.lit(VERSION).cast("long").alias("schemaVersion"), F.struct(lit("as_of").alias("asOf"), F.lit("standard-api").alias("basis"), F.array(*map(F.lit, told["pricing"])).alias("sources")).alias("pricing"), lit("organization").alias("organization"), lit("timezone").alias("timezone"), lit("cutoff").alias("generatedAt"),
        lit("cutoff").alias("cutoff"), F.get("days", F.lit(0))["date"].alias("periodStart"), F.element_at("days", -1)["date"].alias("periodEnd"), F.when(F.col("whole"), "ok").otherwise("partial").alias("collectionStatus"), "sources",
        F.struct(lit("unallocated").cast("long").alias("unallocatedUsageRecords"), lit("ambiguous").cast("long").alias("excludedAmbiguousRecords"), lit("scope").alias("scopeStatus"), F.coalesce(F.col("scope").cast(_SCOPE), none).alias("undated")).alias("coverage"),
        F.struct(*[F.col(f"`{r}`").alias(str(r)) for r in RANGES]).alias("inputRanges"), "days",
    ).cast(DOCUMENT).alias("document")).select("document.*")


def export(document: DataFrame, folder: str, private: list[str]) -> str:
    """Writes a document as ``activity.json`` in a folder that Spark reaches: staged, checked as loaded, renamed last."""
    spark = document.sparkSession
    text = document.select(F.to_json(F.struct(*document.columns), {"ignoreNullFields": "false"}).alias("value"))
    stage = f"{folder}/.stage-{uuid.uuid4()}"
    text.coalesce(1).write.text(stage)  # one row
    load(spark, stage)
    shown = [p for p in private if p]
    leaks = spark.read.text(stage, wholetext=True).filter(reduce(lambda a, b: a | b, [F.contains("value", F.lit(p)) for p in shown], F.lit(False)))
    if not leaks.isEmpty():
        raise ValueError("private strings would be public")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(hadoop.Path(stage)) if s.getPath().getName().startswith("part-"))
    target = hadoop.Path(f"{folder}/activity.json")
    fs.delete(target, False)
    fs.rename(part, target)
    fs.delete(hadoop.Path(stage), True)
    return f"{folder}/activity.json"
