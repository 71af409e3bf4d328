"""Evidence and statuses of the whole document, and scope of single records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields, quality

DIMENSIONS = {"tokens": ("token_quality", fields.TIMING), "work": ("work_quality", fields.ACCOUNTING)}


def by_agent(sources: DataFrame, agents: tuple[str, ...]) -> DataFrame:
    """(agent, dimension, status, reasons) of each agent; one without a source is unavailable for want of it.

    ``sources``: agent, token_quality, work_quality, reasons. Reasons that say nothing about a dimension are left out.
    """
    every = sources.sparkSession.createDataFrame([(a,) for a in agents], "agent string")
    out = []
    for name, (column, without) in DIMENSIONS.items():
        told = sources.groupBy("agent").agg(quality.combined(column).alias("status"), quality.all_reasons("reasons").alias("reasons"))
        status = F.coalesce("status", F.lit("unavailable"))
        reasons = F.when(F.col("status").isNull(), F.array(F.lit("missing-source"))).otherwise(fields.relevant("reasons", without))
        out.append(every.join(told, "agent", "left").select("agent", F.lit(name).alias("dimension"), status.alias("status"), reasons.alias("reasons")))
    return out[0].unionByName(out[1])


def of_all(evidence: DataFrame) -> DataFrame:
    """(dimension, status, reasons) over all agents of by_agent()."""
    return evidence.groupBy("dimension").agg(quality.combined("status").alias("status"), quality.all_reasons("reasons").alias("reasons"))


def collection(sources: DataFrame, git: DataFrame, agents: tuple[str, ...], run_status: Column) -> DataFrame:
    """(status): partial if the last run was, an agent lacks a source, a source is not whole, or commits lack one; else ok. One row."""
    whole = (F.col("state") == "available") & (F.col("token_quality") == "recorded") & (F.col("work_quality") == "recorded")
    mine = sources.filter(F.col("agent").isin(*agents)).agg(F.count_distinct("agent").alias("with_source"), F.coalesce(F.bool_and(whole), F.lit(True)).alias("whole"))
    theirs = git.agg(F.coalesce(F.bool_and(F.col("state") == "available"), F.lit(False)).alias("read"))
    bad = (run_status == "partial") | (F.col("with_source") < len(agents)) | ~F.col("whole") | ~F.col("read")
    return mine.crossJoin(F.broadcast(theirs)).select(F.when(F.coalesce(bad, F.lit(False)), "partial").otherwise("ok").alias("status"))


def scope(evidence: DataFrame, usage: DataFrame, sources: DataFrame) -> DataFrame:
    """(status): recorded if there is scope evidence, every usage origin has it, and all sources are available. One row."""
    legacy = usage.join(evidence.select("origin"), "origin", "left_anti").agg((F.count("*") > 0).alias("legacy"))
    there = evidence.agg((F.count("*") > 0).alias("there"))
    open_ = sources.agg(F.coalesce(F.bool_and(F.col("state") == "available"), F.lit(True)).alias("open"))
    one = there.crossJoin(F.broadcast(legacy)).crossJoin(F.broadcast(open_))
    return one.select(F.when(F.col("there") & ~F.col("legacy") & F.col("open"), "recorded").otherwise("partial").alias("status"))


def work_status(evidence: Column, lanes: Column) -> Column:
    """Status of a window's work: work that was seen though its source's evidence is unavailable is partial."""
    return F.when((evidence == "unavailable") & lanes, "partial").otherwise(evidence)


def record_scope(records: DataFrame, own: DataFrame, sessions: DataFrame) -> DataFrame:
    """Adds decision and reason: a record's own place decides where it is absolute, else its session's scope.

    ``own``: (origin, decision, reason) of records with an absolute place; ``sessions``: (agent, session, decision, reason).
    """
    o = own.select("origin", F.struct("decision", "reason").alias("_own"))
    s = sessions.select("agent", "session", F.struct("decision", "reason").alias("_session"))
    none = F.struct(F.lit("unattributed").alias("decision"), F.lit("attribution-unavailable").alias("reason"))
    out = records.join(o, "origin", "left").join(s, ["agent", "session"], "left").withColumn("_s", F.coalesce("_own", "_session", none))
    return out.withColumns({"decision": F.col("_s.decision"), "reason": F.col("_s.reason")}).drop("_own", "_session", "_s")


def degraded(sources: DataFrame, scoped: DataFrame) -> DataFrame:
    """``sources`` (source, ...) less sure by their unattributed records: counted, told as a reason, and recorded becomes partial."""
    n = scoped.groupBy("source").agg(F.count_if(F.col("decision") == "unattributed").alias("unattributed"))
    out = sources.join(n, "source", "left").withColumn("unattributed", F.coalesce("unattributed", F.lit(0)))
    hit = F.col("unattributed") > 0
    less = {c: F.when(hit & (F.col(c) == "recorded"), "partial").otherwise(F.col(c)) for c in ("token_quality", "work_quality")}
    return out.withColumns({"reasons": F.when(hit, F.array_sort(F.array_distinct(F.concat("reasons", F.array(F.lit("unattributed-session")))))).otherwise(F.col("reasons")), **less})


def all_harnesses(groups: DataFrame) -> DataFrame:
    """(inputs, sessions, status): harness groups as one. ``groups``: harness, inputs (null: none), sessions, status, enabled. One row.

    Null groups add nothing; the whole is partial if a known group or an enabled one isn't recorded.
    """
    gap = (F.col("inputs").isNotNull() | F.col("enabled")) & (F.col("status") != "recorded")
    status = F.when(F.count("inputs") == 0, "unavailable").when(F.coalesce(F.bool_or(gap), F.lit(False)), "partial").otherwise("recorded")
    return groups.agg(F.sum("inputs").alias("inputs"), F.sum(F.when(F.col("inputs").isNotNull(), F.col("sessions"))).alias("sessions"), status.alias("status"))
