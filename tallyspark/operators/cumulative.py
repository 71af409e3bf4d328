"""Counters that only grow, read now and then: what each reading adds, when it can be dated, and the state between runs.

A counter's first reading counts as a whole if it was first and last seen on one reporting date; later ones count by what
they grew since the reading before, if both lie on one date. Other growth is real but can't be dated: it is kept without
a time as unallocated history. A reading in which any value falls begins a new epoch: nothing of it is billed, it is
only what later readings are measured against. Counters that another source owns are never billed; those whose route is
not resolved are kept undated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock, fields
from ..functions.quality import CEILING

COUNTS = ("uncached", "cache_read", "cache_write", "output", "reasoning", "total")
VALUES = (*COUNTS, "cost_micro")
#: What a reading is kept as between runs.
STATE = ("counter", "session", "provider", "model", "epoch", "observed_ms", "first_ms", "last_ms", *VALUES, "cost_kind")


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in columns])


def micro(dollars: Column) -> Column:
    """Dollars as micro-USD, halves up; unlike a price, a counter may stand at zero."""
    made = F.floor(dollars * 1_000_000 + 0.5).cast("long")
    return F.when((dollars >= 0) & (dollars <= CEILING / 1_000_000), made)


def normalised(rows: DataFrame, *keep: str) -> DataFrame:
    """Rows of the five native counts and a cost as ``VALUES``, ``cost_kind`` and ``partial``: a count missing, or more reasoning than output."""
    native = ("input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens", "reasoning_tokens")
    rows = rows.select(*keep, *[F.when(F.col(n).between(0, CEILING), F.col(n)).alias(c) for n, c in zip(native, COUNTS)], *(F.col(c) for c in ("cost_status", "actual_cost_usd", "estimated_cost_usd")))
    over = F.coalesce(F.col("reasoning") > F.col("output"), F.lit(False))
    status = F.lower("cost_status")
    money = F.when(status == "actual", micro(F.col("actual_cost_usd"))).when(status == "estimated", micro(F.col("estimated_cost_usd")))
    unpriced = F.coalesce(status.isin("actual", "estimated"), F.lit(False)) & F.col("cost_micro").isNull()
    rows = rows.withColumns({"cost_micro": money, "_over": over, "_lacks": _any([F.col(c).isNull() for c in COUNTS[:5]])})
    kind = F.when(unpriced, "unknown").when(status == "actual", "provider-reported").when(status == "estimated", "source-estimate").when(status == "included", "included").otherwise("unknown")
    total = F.col("uncached") + F.col("cache_read") + F.col("cache_write") + F.col("output")
    rows = rows.withColumns({"cost_kind": kind, "partial": F.col("_over") | F.col("_lacks"), "reasoning": F.when(~F.col("_over"), F.col("reasoning")), "total": total})
    return rows.select(*keep, *VALUES, "cost_kind", "partial")


def _routed(*parts: str) -> Column:
    return fields.joined_id(*[F.coalesce(F.col(p), F.lit("")) for p in parts])


def sessions(native: DataFrame) -> DataFrame:
    """Native sessions with an id and a start; times in milliseconds, values normalised, and the id of their route."""
    ms = lambda c: F.when(F.col(c) >= 0, F.round(F.col(c) * 1000).cast("long"))
    rows = native.filter((F.col("id") != "") & (F.col("started_at") >= 0)).select(
        "path", F.col("id").alias("session"), F.nullif("parent_session_id", F.lit("")).alias("parent"), ms("started_at").alias("started_ms"), ms("ended_at").alias("ended_ms"), ms("last_activity_at").alias("active_ms"),
        F.coalesce(F.nullif("cwd", F.lit("")), F.nullif("git_repo_root", F.lit(""))).alias("workspace"), F.nullif("git_repo_root", F.lit("")).alias("repository"), F.trim("billing_provider").alias("billing_provider"),
        "billing_base_url", "billing_mode", "input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens", "reasoning_tokens", "cost_status", "actual_cost_usd", "estimated_cost_usd",
    )
    rows = rows.withColumn("route", _routed("session", "billing_provider", "billing_base_url", "billing_mode")).withColumn("provider", fields.labelled(F.col("billing_provider")))
    return normalised(rows, "path", "session", "parent", "started_ms", "ended_ms", "active_ms", "workspace", "repository", "provider", "route")


def by_model(native: DataFrame) -> DataFrame:
    """Native counters by session, model, route and task."""
    ms = lambda c: F.when(F.col(c) >= 0, F.round(F.col(c) * 1000).cast("long"))
    rows = native.filter(F.col("session_id") != "").select(
        "path", F.col("session_id").alias("session"), fields.labelled(F.col("model")).alias("model"), F.coalesce(F.trim("billing_provider"), F.lit("")).alias("billing_provider"), "billing_base_url", "billing_mode",
        F.coalesce(F.trim("task"), F.lit("")).alias("task"), ms("first_seen").alias("first_ms"), ms("last_seen").alias("last_ms"), "input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens",
        "reasoning_tokens", "cost_status", "actual_cost_usd", "estimated_cost_usd",
    )
    auto = (F.col("billing_provider") == "") | (F.lower("billing_provider") == "auto")
    rows = rows.withColumns({
        "counter": F.concat(F.lit("model:"), _routed("session", "model", "billing_provider", "billing_base_url", "billing_mode", "task")),
        "provider": fields.labelled(F.col("billing_provider")), "upstream": F.lower("billing_provider") == "openai-codex", "unresolved": (F.col("task") != "") & auto,
    })
    made = normalised(rows, "path", "session", "counter", "model", "provider", "task", "first_ms", "last_ms", "upstream", "unresolved")
    return made.withColumn("partial", F.col("partial") | F.col("first_ms").isNull() | F.col("last_ms").isNull())


def chosen(copies: DataFrame, rows: DataFrame) -> DataFrame:
    """One copy of each session (id, start) that several stores hold, with ``ambiguous``.

    The copy that no other exceeds in any value, its own or a counter's; else the one seen last, flagged. Maxima of the
    group decide: a copy dominates if each known value of its is the group's greatest and it has every counter of the group.
    """
    group = ["session", "started_ms"]
    tall = lambda values: reduce(lambda a, b: a & b, [F.coalesce(F.col(f"r.{v}") >= F.col(f"m.{v}"), F.lit(True)) for v in values])
    most = copies.groupBy(*group).agg(F.count("*").alias("copies"), *[F.max(v).alias(v) for v in VALUES])
    r = rows.join(copies.select("path", *group), ["path", "session"])
    peak = r.groupBy(*group, "counter").agg(*[F.max(v).alias(v) for v in VALUES])
    of = r.alias("r").join(peak.alias("m"), [*group, "counter"])
    whole = of.groupBy("r.path", *group).agg(F.count_distinct(F.when(tall(VALUES), F.col("r.counter"))).alias("reached"), F.max("r.last_ms").alias("row_ms"))
    wanted = peak.groupBy(*group).agg(F.count("*").alias("wanted"))
    c = copies.alias("r").join(most.alias("m"), group).select(*group, F.col("r.path").alias("path"), F.col("m.copies").alias("copies"), tall(VALUES).alias("tall"), F.greatest("r.active_ms", "r.ended_ms").alias("seen_ms"))
    c = c.join(whole, ["path", *group], "left").join(wanted, group, "left")
    c = c.withColumn("dominant", F.col("tall") & (F.coalesce("reached", F.lit(0)) == F.coalesce("wanted", F.lit(0))))
    order = F.struct(~F.col("dominant"), -F.coalesce(F.greatest("seen_ms", "row_ms"), F.lit(0)), F.col("path"))
    best = c.groupBy(*group).agg(F.min_by(F.struct("path", "dominant", "copies"), order).alias("x"))
    return best.select(*group, "x.path", (~F.col("x.dominant") & (F.col("x.copies") > 1)).alias("ambiguous"))


def residuals(copies: DataFrame, rows: DataFrame) -> DataFrame:
    """What a session counts beyond its counters without a task, value by value, where none is negative and any is positive."""
    known = [F.when(F.count(v) == F.count("*"), F.sum(v)).alias(f"_{v}") for v in COUNTS]
    main = rows.filter("task = ''").groupBy("path", "session").agg(*known, F.lit(True).alias("_some"))
    j = copies.join(main, ["path", "session"], "left")
    rest = {v: F.col(v) - F.when(F.col("_some"), F.col(f"_{v}")).otherwise(F.lit(0)) for v in COUNTS}
    j = j.select("path", "session", F.concat(F.lit("residual:"), "route").alias("counter"), F.lit("unknown").alias("model"), "provider", F.lit("").alias("task"), F.col("started_ms").alias("first_ms"), F.coalesce("ended_ms", "active_ms").alias("last_ms"), F.lit(False).alias("upstream"), F.lit(False).alias("unresolved"), *[x.alias(v) for v, x in rest.items()])
    j = j.withColumns({"cost_micro": F.lit(None).cast("long"), "cost_kind": F.lit("unknown"), "partial": _any([F.col(v).isNull() for v in COUNTS])})
    return j.filter(~_any([F.col(v) < 0 for v in COUNTS]) & _any([F.col(v) > 0 for v in COUNTS]))


def counters(native_sessions: DataFrame, native_models: DataFrame, cutoff_ms: int) -> DataFrame:
    """Readings of all counters of the chosen copies, residual ones among them, that were not last seen after the cutoff."""
    s, rows = sessions(native_sessions), by_model(native_models)
    pick = chosen(s, rows)
    s = s.join(pick, ["path", "session", "started_ms"])
    rows = rows.join(s.select("path", "session", "ambiguous", "workspace", "repository"), ["path", "session"])
    rest = residuals(s.drop("ambiguous"), rows).join(s.select("path", "session", "workspace", "repository"), ["path", "session"]).withColumn("ambiguous", F.lit(False))
    return rows.unionByName(rest).drop("path").filter(F.col("last_ms").isNull() | (F.col("last_ms") <= cutoff_ms))


def _grown(readings: DataFrame, zone: str) -> DataFrame:
    """Readings with ``was``, the struct of the one before: what is billed, when, and in which epoch."""
    day = lambda ms: clock.local_date(ms, zone)
    cur, was = {v: F.col(v) for v in VALUES}, {v: F.col(f"was.{v}") for v in VALUES}
    first, blocked = F.col("was").isNull(), F.col("upstream") | F.col("unresolved")
    fall = ~blocked & ~first & _any([cur[v] < was[v] for v in VALUES])
    changed = reduce(lambda a, b: a | b, [~cur[v].eqNullSafe(was[v]) for v in VALUES])
    r = readings.withColumns({"fall": fall, "changed": ~first & changed, "active": _any([cur[v] > 0 for v in VALUES])})
    since = F.when(first, F.col("first_ms")).otherwise(F.col("was.last_ms"))
    same = F.coalesce((since <= F.col("last_ms")) & (day(since) == day(F.col("last_ms"))), F.lit(False))
    r = r.withColumn("same", same)
    moved = F.when(first, F.col("active")).otherwise(F.col("changed") & ~F.col("fall"))
    undated = F.when(blocked, F.col("unresolved")).otherwise(F.col("fall") | (moved & ~F.col("same") & F.col("active")))
    r = r.withColumn("undated", undated)
    kept = ~F.col("upstream") & ~F.col("fall") & (F.col("undated") | (~blocked & moved & F.col("same")))
    kind = F.when(first | F.col("undated") | (F.col("was.cost_kind") == F.col("cost_kind")), F.lit(True)).otherwise(F.lit(False))
    add = {v: F.when(first, cur[v]).otherwise(cur[v] - was[v]) for v in VALUES}
    add["cost_micro"] = F.when(kind, add["cost_micro"])
    r = r.withColumn("add", F.struct(*[x.alias(v) for v, x in add.items()]))
    return r.withColumn("billed", kept & _any([F.col(f"add.{v}") > 0 for v in VALUES]))


def _usage(grown: DataFrame) -> DataFrame:
    """Grown readings that are billed, as usage records."""
    reasons = F.array(F.when(F.col("partial"), "parse-gap"), F.when(F.col("ambiguous"), "duplicate-ambiguity"), F.when(F.col("undated"), "unallocated-history"))
    at = F.when(~F.col("undated"), F.col("last_ms"))
    was = [F.when(F.col("was").isNull(), "initial").otherwise(F.coalesce(F.col(f"was.{v}").cast("string"), F.lit("null"))) for v in VALUES]
    origin = fields.joined_id(F.col("counter"), F.col("epoch"), *was, *[F.coalesce(F.col(f"add.{v}").cast("string"), F.lit("null")) for v in VALUES], at)
    money = F.col("add.cost_micro")
    return grown.filter("billed").select(
        origin.alias("origin"), "counter", "session", at.alias("at_ms"), "provider", "model", F.nullif("task", F.lit("")).alias("task"), "epoch", *[F.col(f"add.{v}").alias(v) for v in VALUES],
        F.when(money.isNull() & (F.col("cost_kind") != "included"), "unknown").otherwise(F.col("cost_kind")).alias("cost_kind"),
        F.when(F.col("partial") | F.col("ambiguous") | F.col("undated"), "partial").otherwise("recorded").alias("quality"), F.array_sort(F.array_compact(reasons)).alias("reasons"),
    )


def step(observed: DataFrame, state: DataFrame | None, zone: str, at_ms: int) -> tuple[DataFrame, DataFrame]:
    """(usage, state) of a run that observes one reading a counter; counters that it doesn't see stay as they were."""
    observed = observed.withColumn("observed_ms", F.lit(at_ms))
    if state is None:
        state = observed.withColumn("epoch", F.lit(0)).select(*STATE).limit(0)
    known = state.select("counter", F.struct(*[c for c in STATE if c != "counter"]).alias("was"))
    grown = _grown(observed.join(known, "counter", "left"), zone)
    grown = grown.withColumn("epoch", F.coalesce("was.epoch", F.lit(0)) + F.col("fall").cast("int"))
    stay = state.join(observed.select("counter"), "counter", "left_anti")
    return _usage(grown), grown.select(*STATE).unionByName(stay.select(*STATE))


def history(readings: DataFrame, zone: str) -> DataFrame:
    """Usage of all readings (counter, observed_ms) at once: what ``step`` would give run by run."""
    order = Window.partitionBy("counter").orderBy("observed_ms")
    grown = _grown(readings.withColumn("was", F.lag(F.struct("first_ms", "last_ms", *VALUES, "cost_kind")).over(order)), zone)
    return _usage(grown.withColumn("epoch", F.sum(F.col("fall").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")))
