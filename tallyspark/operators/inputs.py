"""Submitted inputs: populations with one exclusion each, distinct sessions, and the cadence cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import intervals

EXCLUSIONS = ("undated", "context", "replay", "unknown-kind", "subagent", "unknown-lane", "counted")


def exclusion() -> Column:
    """Why an input isn't counted, the first reason that holds; ``counted`` if none."""
    kind, lane = F.col("kind"), F.col("lane")
    return (
        F.when(F.col("at_ms").isNull(), "undated").when(kind == "context", "context").when(kind == "replay", "replay").when(kind != "submission", "unknown-kind")
        .when(lane == "subagent", "subagent").when(lane != "main", "unknown-lane").otherwise("counted")
    )


def ranged(inputs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Inputs of each range (a handful of rows: range, start_ms, end_ms, both inclusive); undated ones belong to all."""
    return inputs.join(F.broadcast(ranges), F.col("at_ms").isNull() | F.col("at_ms").between(F.col("from_ms"), F.col("to_ms")))


def population(inputs: DataFrame, *keys: str) -> DataFrame:
    return inputs.filter("decision = 'included'").withColumn("outcome", exclusion()).groupBy(*keys, "outcome").agg(F.count("*").alias("inputs"), F.count_distinct("session").alias("sessions"))


def cadence(inputs: DataFrame, states: DataFrame, work: DataFrame, ranges: DataFrame, zone: str, *keys: str) -> DataFrame:
    """(range, keys, state, sessions, inputs, work_ms): each session with counted inputs in a range once, by the first state that holds.

    input-history: a source without usable state, an undated input, or in the range one of unknown kind or lane or not
    recorded; mixed-scope: an input in the range that isn't included; no-recorded-work; measured. Context and replays tell
    nothing. Work counts from the session's first counted input to the range's end, overlaps once.

    ``inputs``: agent, session, source, at_ms, kind, lane, decision, quality; ``states``: source, usable; ``ranges``: a
    handful of rows (days, from_ms, to_ms). Work is fanned out to hours before it is united, so no window holds more than an
    hour of a session.
    """
    lane = ["days", "agent", "session"]
    tells = ~F.col("kind").isin("context", "replay")
    rows = inputs.join(states.select("source", "usable"), "source", "left").withColumn("usable", F.coalesce("usable", F.lit(False))).crossJoin(F.broadcast(ranges))
    within = F.coalesce(F.col("at_ms").between(F.col("from_ms"), F.col("to_ms")), F.lit(False))
    counted = within & (F.col("decision") == "included") & (exclusion() == "counted")
    vague = (F.col("kind") == "unknown") | (F.col("lane") == "unknown") | (F.col("quality") != "recorded")
    s = rows.groupBy(*lane, "to_ms").agg(
        F.count_if(counted).alias("inputs"), F.min(F.when(counted, F.col("at_ms"))).alias("first_ms"), F.bool_or(~F.col("usable") | (F.col("at_ms").isNull() & tells) | (within & tells & vague)).alias("history"),
        F.bool_or(within & tells & (F.col("decision") != "included")).alias("mixed"),
    ).filter("inputs > 0")
    own = work.join(s.filter("not history and not mixed").select(*lane, "first_ms", "to_ms"), ["agent", "session"])
    slots = intervals.fan_out(intervals.clip(own, F.col("first_ms"), F.col("to_ms")).select(*lane, "start_ms", "end_ms"), zone)
    ms = intervals.union(slots, *lane, "date", "slot").groupBy(*lane).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("work_ms"))
    state = F.when(F.col("history"), "input-history").when(F.col("mixed"), "mixed-scope").when(F.col("work_ms").isNull(), "no-recorded-work").otherwise("measured")
    return s.join(ms, lane, "left").withColumn("state", state).groupBy("days", *keys, "state").agg(F.count("*").alias("sessions"), F.sum("inputs").alias("inputs"), F.sum("work_ms").alias("work_ms"))
