"""Who owns a history that several sessions carry, with a memory of prints between runs.

The memory maps the print of a turn, of the first ``LIMIT`` of a session, to the session that owns it. A session whose
first turns are all owned by one other session is its copy. If the newcomer turns out to be the older one, it is promoted:
the prints become its own, the former owner becomes the copy, and what was counted there as submitted becomes a replay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import dedup

LIMIT, LEAST = 32, 2
_NEVER = 2**63 - 1


def recalled(turns: DataFrame, memory: DataFrame, stored: DataFrame) -> DataFrame:
    """(session, owner, prefix, promoted): sessions whose first turns the memory gives to one other session.

    ``turns``: session, pos (from 1), print, role, started_ms; ``memory``: print, owner; ``stored``: session, started_ms of
    sessions known from earlier runs. ``promoted``: the session is older than that owner and takes its place.
    """
    head = turns.filter(F.col("pos") <= LIMIT).join(memory.select("print", "owner"), "print", "left")
    by = Window.partitionBy("session").orderBy("pos")  # LIMIT rows at most
    first = F.first("owner").over(by.rowsBetween(Window.unboundedPreceding, 0))
    other = F.coalesce((F.col("owner") == first) & (F.col("owner") != F.col("session")), F.lit(False))
    head = head.withColumn("_other", other).withColumn("_broken", F.max((~F.col("_other")).cast("int")).over(by))
    run = head.filter("_broken = 0").groupBy("session").agg(F.min("owner").alias("owner"), F.count("*").alias("prefix"), F.max((F.col("role") == "assistant").cast("int")).alias("answered"), F.min("started_ms").alias("started_ms"))
    run = run.filter((F.col("prefix") >= LEAST) & (F.col("answered") == 1))
    was = stored.select(F.col("session").alias("owner"), F.col("started_ms").alias("owner_ms"), F.lit(True).alias("known"))
    now, then = F.col("started_ms"), F.col("owner_ms")
    older = now.isNotNull() & (then.isNull() | (now < then) | ((now == then) & (F.col("session") < F.col("owner"))))
    return run.join(was, "owner", "left").select("session", "owner", "prefix", F.coalesce(F.col("known") & older, F.lit(False)).alias("promoted"))


def owners(turns: DataFrame, memory: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(canonical, duplicates, promoted) of a run's sessions, by their own turns and by the memory.

    canonical: session, owner, for sessions that aren't their own; duplicates: session, pos of turns that another session
    owns; promoted: session (the new owner), owner (the former one), prefix.
    """
    here = dedup.clones(turns.select(F.col("session").alias("conv_id"), F.col("pos").alias("turn"), "print", "role", "started_ms"), LEAST, "started_ms").withColumnRenamed("conv_id", "session")
    told = recalled(turns, memory, stored)
    copies, promoted = told.filter(~F.col("promoted")), told.filter("promoted")
    # Of one former owner the oldest newcomer is the new one.
    taken = promoted.join(turns.select("session", "started_ms").distinct(), "session").groupBy(F.col("owner").alias("session")).agg(F.min_by("session", F.struct(F.coalesce("started_ms", F.lit(_NEVER)), "session")).alias("owner"))
    rank = lambda df, k: df.select("session", "owner", F.lit(k).alias("k"))
    every = rank(here, 1).unionByName(rank(copies, 2)).unionByName(rank(taken, 3))
    canonical = every.groupBy("session").agg(F.max_by("owner", "k").alias("owner"))
    lost = here.select("session", F.col("prefix").cast("long")).unionByName(copies.select("session", F.col("prefix").cast("long"))).groupBy("session").agg(F.max("prefix").alias("prefix"))
    duplicates = turns.join(lost, "session").filter(F.col("pos") <= F.col("prefix")).select("session", "pos")
    return canonical, duplicates, promoted.select("session", "owner", "prefix")


def remembered(turns: DataFrame, memory: DataFrame, canonical: DataFrame, promoted: DataFrame) -> DataFrame:
    """The memory after a run: new prints go to the owner of the earliest session that has them, promoted ones to their new owner, others stay."""
    head = turns.filter(F.col("pos") <= LIMIT).join(canonical, "session", "left").withColumn("owner", F.coalesce("owner", "session"))
    order = F.struct(F.coalesce("started_ms", F.lit(_NEVER)), "session")
    new = head.join(memory, "print", "left_anti").groupBy("print").agg(F.min_by("owner", order).alias("owner"))
    moved = turns.join(promoted.select("session", "prefix"), "session").filter(F.col("pos") <= F.col("prefix"))
    moved = moved.groupBy("print").agg(F.min_by("session", order).alias("owner")).join(new, "print", "left_anti")
    stay = memory.select("print", "owner").join(moved, "print", "left_anti")
    return stay.unionByName(moved).unionByName(new)


def replays(promoted: DataFrame) -> DataFrame:
    """(session, prefix): of former owners, how many leading turns are replays from now on."""
    return promoted.groupBy(F.col("owner").alias("session")).agg(F.max("prefix").alias("prefix"))


def ambiguous(turns: DataFrame, duplicates: DataFrame, memory: DataFrame) -> DataFrame:
    """(session, pos) of counted turns that are left out though no prefix explains them.

    Of turns of one print all but the earliest (by start, session and place) are, and turns whose print the memory gives
    to another session; ``duplicates`` are left out by their prefix and don't count here.
    """
    rows = turns.filter("counted").select("session", "pos", "print", "started_ms")
    order = F.struct(F.coalesce("started_ms", F.lit(_NEVER)).alias("s"), F.col("session").alias("session"), F.col("pos").alias("pos"))
    first = rows.groupBy("print").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = rows.join(first, "print").filter((F.col("first.session") != F.col("session")) | (F.col("first.pos") != F.col("pos"))).select("session", "pos")
    foreign = rows.join(memory.select("print", "owner"), "print").filter(F.col("owner") != F.col("session")).select("session", "pos")
    return again.union(foreign).distinct().join(duplicates, ["session", "pos"], "left_anti")
