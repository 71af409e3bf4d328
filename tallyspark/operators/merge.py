"""Merging observations of one input, those of this run and the retained one, whatever order they come in.

The owner is sticky: a retained record that isn't a replay, the earliest of them; without any, a retained replay, and
without that the earliest of this run. The owner's latest observation of this run speaks for it. A copy that has another
time makes the kind unknown. Evidence is a lattice: a conflict, once seen, stays; two origins conflict; one origin is
known from the source if any record that gives it has it from there, else by provenance. A controller holds if all that
name one agree, and none does after a conflict that was retained.

Observations are folded by identity first and then by input, each fold an aggregate with partial sums, so neither their
order nor their number matters; a time other than the owner's is sought by a join of identities with owners.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Who observed: two records of one identity are one owner's.
IDENTITY = ("agent", "session", "native_session", "native_input")
_NEVER = 2**63 - 1


def _with(codes, code: str):
    return F.array_sort(F.array_distinct(F.concat(codes, F.array(F.lit(code)))))


def merged(records: DataFrame) -> DataFrame:
    """One record for each ``origin``.

    ``records``: origin, retained (boolean), ordinal (place in this run), IDENTITY, source, at_ms, kind, quality, reasons,
    by_whom (human, automated, unknown), evidence (source, provenance, conflict, none), controller, and more, which is
    the chosen record's.
    """
    columns = [c for c in records.columns if c not in ("origin", "retained", "ordinal")]
    rank = F.when(F.col("retained"), F.when(F.col("kind") == "replay", 1).otherwise(0)).otherwise(2)
    order = F.struct(rank.alias("rank"), F.coalesce("at_ms", F.lit(_NEVER)).alias("at"), F.col("session").alias("s"), F.col("native_session").alias("n"), F.col("source").alias("o"), F.col("ordinal").alias("i"))
    whole = F.struct(*columns)
    known = F.col("by_whom") != "unknown"
    each = records.groupBy("origin", *IDENTITY).agg(
        F.min(order).alias("order"), F.min_by(whole, order).alias("least"), F.max_by(whole, F.when(~F.col("retained"), F.col("ordinal"))).alias("latest"),
        F.min("at_ms").alias("low"), F.max("at_ms").alias("high"), F.bool_or(F.col("evidence") == "conflict").alias("conflict"), F.min(F.when(known, F.col("by_whom"))).alias("who_a"), F.max(F.when(known, F.col("by_whom"))).alias("who_b"),
        F.coalesce(F.bool_or(known & (F.col("evidence") == "source")), F.lit(False)).alias("native"), F.min("controller").alias("by_a"), F.max("controller").alias("by_b"),
    )
    latest = F.when(F.col("latest").isNotNull(), F.col("latest")).otherwise(F.col("least"))
    owner = each.groupBy("origin").agg(
        F.min_by(latest, "order").alias("r"), F.min_by(F.struct("least.at_ms", *IDENTITY), "order").alias("o"), F.bool_or("conflict").alias("sticky"), F.min("who_a").alias("who_a"), F.max("who_b").alias("who_b"),
        F.bool_or("native").alias("native"), F.min("by_a").alias("by_a"), F.max("by_b").alias("by_b"),
    )
    same = F.lit(True)
    for c in IDENTITY:
        same = same & F.col(c).eqNullSafe(F.col(f"o.{c}"))
    off = F.coalesce((F.col("low") != F.col("o.at_ms")) | (F.col("high") != F.col("o.at_ms")), F.lit(False))
    apart = each.select("origin", *IDENTITY, "low", "high").join(owner.select("origin", "o"), "origin").filter(~same & off).select("origin").distinct().withColumn("apart", F.lit(True))
    out = owner.join(apart, "origin", "left").select("origin", *[F.col(f"r.{c}").alias(c) for c in columns], "sticky", "who_a", "who_b", "native", "by_a", "by_b", F.coalesce("apart", F.lit(False)).alias("apart"))
    clash = F.col("sticky") | F.coalesce(F.col("who_a") != F.col("who_b"), F.lit(False))
    codes = F.when(F.col("apart"), _with(F.col("reasons"), "input-kind-unknown")).otherwise(F.col("reasons"))
    done = {
        "kind": F.when(F.col("apart"), "unknown").otherwise(F.col("kind")), "quality": F.when(F.col("apart"), "partial").otherwise(F.col("quality")),
        "reasons": F.when(clash, _with(codes, "input-origin-conflict")).otherwise(codes), "by_whom": F.when(clash | F.col("who_a").isNull(), "unknown").otherwise(F.col("who_a")),
        "evidence": F.when(clash, "conflict").when(F.col("who_a").isNull(), "none").when(F.col("native"), "source").otherwise("provenance"),
        "controller": F.when(~F.col("sticky") & (F.col("by_a") == F.col("by_b")), F.col("by_a")),
    }
    return out.withColumns(done).drop("sticky", "who_a", "who_b", "native", "by_a", "by_b", "apart")
