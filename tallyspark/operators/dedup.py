"""Choosing one record of many: dedup, revisions, owners, prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTED = ("uncached", "cache_read", "cache_write", "output", "reasoning", "total", "cost_micro", "at_ms")


def completeness(quality: str = "quality", fields: tuple[str, ...] = COUNTED) -> Column:
    base = F.when(F.col(quality) == "recorded", 100).when(F.col(quality) == "partial", 50).otherwise(0)
    return base + sum((F.col(f).isNotNull().cast("int") for f in fields[1:]), F.col(fields[0]).isNotNull().cast("int"))


def best(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key; Spark drops others before the shuffle (a group limit)."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


#: What two records of one origin must agree in.
ACCOUNTING = ("at_ms", "provider", "model", "uncached", "cache_read", "cache_write", "output", "reasoning", "total", "cost_micro", "cost_kind")


def by_arrival(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The record of each key that stays when they come in by ``ordinal``: (keys, ordinal, score, conflict).

    A record takes the place of one that isn't more complete. If both are equally complete but differ, or the earlier one
    has a gap, what stays is partial with a gap from then on (conflict), so its score is that of a partial record: later
    recorded ones always take its place, partial ones if they know as many fields, others never. That makes the fold two
    steps of windows: up to the first conflict the running maximum of scores, and after it, from the last recorded
    record on, the partial one that knows most. Ties go to the later. Nulls differ from values, not from each other.
    """
    known = sum((F.col(f).isNotNull().cast("int") for f in COUNTED[1:]), F.col(COUNTED[0]).isNotNull().cast("int"))
    rows = df.select(*keys, ordinal, "quality", known.alias("known"), completeness().alias("score"), F.coalesce(F.array_contains("reasons", "parse-gap"), F.lit(False)).alias("gap"), F.struct(*ACCOUNTING).alias("told"))
    every = Window.partitionBy(*keys)
    before = every.orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    top = F.max("score").over(before)
    rows = rows.withColumn("took", F.coalesce(F.col("score") >= top, F.lit(True)))
    rows = rows.withColumn("prior", F.last(F.when(F.col("took"), F.struct("score", "gap", "told")), ignorenulls=True).over(before))
    differs = F.col("prior.gap") | ((F.col("prior.score") == F.col("score")) & ~F.col("prior.told").eqNullSafe(F.col("told")))
    rows = rows.withColumn("turn", F.min(F.when(F.col("took") & F.coalesce(differs, F.lit(False)), F.col(ordinal))).over(every)).drop("prior", "told")
    start = (F.col(ordinal) == F.col("turn")) | ((F.col(ordinal) > F.col("turn")) & (F.col("quality") == "recorded"))
    rows = rows.withColumn("start", F.max(F.when(start, F.col(ordinal))).over(every))
    after = (F.col(ordinal) == F.col("start")) | ((F.col(ordinal) > F.col("start")) & (F.col("quality") == "partial"))
    rows = rows.filter(F.when(F.col("turn").isNull(), F.col("took")).otherwise(after))
    conflict = F.col("turn").isNotNull()
    return best(rows, keys, F.when(conflict, F.col("known")).otherwise(F.col("score")).desc(), F.desc(ordinal)).select(*keys, ordinal, F.when(conflict, 50 + F.col("known")).otherwise(F.col("score")).alias("score"), conflict.alias("conflict"))


def last(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The record with the greatest ordinal of each key, by a partial maximum."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("r")).select(key, "r.*")


def revisions(df: DataFrame, key: str, at: str, sequence: str, complete: str, counters: tuple[str, ...] = ("total",)) -> DataFrame:
    """The latest complete revision, else the latest; owner: the earliest; time: the least seen; conflict: complete ones differ in a counter.

    Complete revisions agree if each counter is null in all of them or the same in all.
    """
    order = F.struct(F.coalesce(F.col(at), F.lit(-1)).alias("a"), F.col(sequence).alias("s"))
    whole = F.when(F.col(complete), F.struct(*counters))
    of = lambda c: F.when(F.col(complete), F.col(c))
    differ = [~F.min(of(c)).eqNullSafe(F.max(of(c))) | ((F.count(of(c)) > 0) & (F.count(of(c)) < F.count(whole))) for c in counters]
    conflict = differ[0]
    for d in differ[1:]:
        conflict = conflict | d
    return df.groupBy(key).agg(
        F.max(F.struct(F.col(complete).alias("c"), order.alias("o"), F.col("total").alias("total"))).alias("r"), F.min(F.struct(F.col(sequence), F.col("session"))).alias("first"),
        F.min(at).alias("at_ms"), conflict.alias("conflict"),
    ).select(key, F.col("r.total").alias("total"), F.col("r.c").alias("complete"), F.col("first.session").alias("owner"), "at_ms", "conflict")


def chosen_revision(df: DataFrame, key: str, at: str, line: tuple[str, ...], file: tuple[str, ...], complete: str, counters: tuple[str, ...]) -> DataFrame:
    """(key, counters, complete, owner, at, conflict): the latest complete revision, else the latest, by (time, ``line``).

    The owner is the session of the earliest file, by ``file`` (its creation, path and place); the time is the least
    seen; complete revisions that differ in any counter conflict.
    """
    order = F.struct(F.col(complete).alias("c"), F.coalesce(F.col(at), F.lit(-1)).alias("a"), *line)
    whole = F.when(F.col(complete), F.xxhash64(F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in counters])))
    g = df.groupBy(key).agg(F.max_by(F.struct(*counters, F.col(complete).alias("complete")), order).alias("r"), F.min_by("session", F.struct(*file)).alias("owner"), F.min(at).alias(at), F.coalesce(F.min(whole) != F.max(whole), F.lit(False)).alias("conflict"))
    return g.select(key, "r.*", "owner", at, "conflict")


def chained(turns: DataFrame, key: str, order: str, *more: str) -> DataFrame:
    """Turns with ``pos`` (from 1) and ``upto``: 128 bits of all prints up to here, so that equal ``upto`` are equal prefixes.

    Each print is hashed with its place, and the hashes are folded as they come; a turn costs the same however long the
    sequence is.
    """
    by = Window.partitionBy(key).orderBy(order)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    t = turns.select(key, order, "print", *more, F.row_number().over(by).alias("pos"))
    hashes = [F.bit_xor(F.xxhash64(F.lit(seed), "pos", "print")).over(upto) for seed in (1, 2)]
    return t.withColumn("upto", F.struct(hashes[0].alias("a"), hashes[1].alias("b")))


def common_prefix(turns: DataFrame) -> DataFrame:
    """(conv_id, prefix, first, members): the most leading prints that a sequence shares with another, how many share them, and the least of those.

    Sequences that agree up to a place are one group, known by the chained print of the prefix; no pairs are made.
    """
    t = chained(turns, "conv_id", "turn").select("conv_id", "pos", "upto")
    groups = t.groupBy("pos", "upto").agg(F.min("conv_id").alias("first"), F.count("*").alias("members")).filter("members > 1")
    longest = t.join(groups, ["pos", "upto"]).groupBy("conv_id").agg(F.max(F.struct("pos", "first", "members")).alias("x"))
    return longest.select("conv_id", F.col("x.pos").cast("bigint").alias("prefix"), "x.first", "x.members")


def clones(turns: DataFrame, least: int = 2, since: str | None = None) -> DataFrame:
    """(conv_id, owner, prefix): sequences that repeat another's first turns, an assistant's among them.

    The owner is the earliest by the column ``since`` (null: last), else the least. Sequences are grouped by the chained
    print of each prefix, so a prefix that many share is one group and no pairs.
    """
    turns = turns.withColumn("_since", F.coalesce(F.col(since), F.lit(2**63 - 1)) if since else F.lit(0).cast("long"))
    t = chained(turns, "conv_id", "turn", "role", "_since")
    answered = F.max((F.col("role") == "assistant").cast("int")).over(Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    owned = t.withColumn("answered", answered).filter((F.col("pos") >= least) & (F.col("answered") == 1))
    owner = owned.groupBy("pos", "upto").agg(F.min(F.struct("_since", "conv_id")).alias("o"), F.count("*").alias("n")).filter("n > 1")
    hit = owned.join(owner.select("pos", "upto", F.col("o.conv_id").alias("owner")), ["pos", "upto"]).filter("conv_id <> owner")
    return hit.groupBy("conv_id").agg(F.max(F.struct("pos", "owner")).alias("x")).select("conv_id", F.col("x.owner").alias("owner"), F.col("x.pos").cast("bigint").alias("prefix"))


def dominant(copies: DataFrame, keys: list[str], counters: list[str], newest: str) -> DataFrame:
    """The copy that no counter of any other exceeds; else the newest, flagged. Group maxima decide, no pairs."""
    most = copies.groupBy(*keys).agg(*[F.max(c).alias(f"_{c}") for c in counters])
    tall = sum((F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(True)).cast("int") for c in counters[1:]), F.coalesce(F.col(counters[0]) == F.col(f"_{counters[0]}"), F.lit(True)).cast("int"))
    m = copies.join(most, keys).withColumn("dominant", tall == len(counters)).drop(*[f"_{c}" for c in counters])
    return best(m, keys, F.desc("dominant"), F.desc(newest)).withColumn("ambiguous", ~F.col("dominant")).drop("dominant")
