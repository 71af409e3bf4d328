"""Provenance claims about inputs: a strict feed, claims kept for ever, and inputs settled anew whenever either side grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["agent", "native_session", "native_input"]
#: The feed's agents, origins and longest controller.
AGENTS, ORIGINS, CONTROLLER = ("codex", "claude", "omp", "opencode", "hermes"), ("human", "automated"), 128
_TYPES = "OBJECT<agent: STRING, {}inputId: STRING, origin: STRING, sessionId: STRING, status: STRING, version: BIGINT>"


def parsed(lines: DataFrame) -> DataFrame:
    """``lines`` (line) with ``claim`` (KEY, by_whom, controller), or in ``gap`` why there is none.

    A line must be one JSON object of exactly the feed's keys and types: any other key, type or value is unsupported, what
    is no JSON (or has a key twice) a parse gap.
    """
    v = lines.withColumn("_v", F.try_parse_json("line")).withColumn("_t", F.schema_of_variant("_v"))
    text = lambda k: F.try_variant_get("_v", f"$.{k}", "string")
    typed = F.col("_t").isin(_TYPES.format(""), _TYPES.format("controller: STRING, "))
    sound = typed & (F.try_variant_get("_v", "$.version", "bigint") == 1) & text("agent").isin(*AGENTS) & text("origin").isin(*ORIGINS) & (text("status") == "delivered")
    sound = sound & (F.length(text("sessionId")) > 0) & (F.length(text("inputId")) > 0) & F.coalesce(F.length(text("controller")).between(1, CONTROLLER), F.lit(True))
    claim = F.struct(text("agent").alias("agent"), text("sessionId").alias("native_session"), text("inputId").alias("native_input"), text("origin").alias("by_whom"), text("controller").alias("controller"))
    gap = F.when(F.col("_v").isNull(), "parse-gap").when(~F.coalesce(sound, F.lit(False)), "unsupported-schema")
    return v.withColumns({"gap": gap, "claim": F.when(gap.isNull(), claim)}).drop("_v", "_t")


def retained(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """All claims ever made, each once."""
    columns = [*KEY, "by_whom", "controller"]
    return (new if old is None else old.select(*columns).unionByName(new.select(*columns))).select(*columns).distinct()


def reconciled(inputs: DataFrame, native: DataFrame, claims: DataFrame, cutoff_ms: int) -> DataFrame:
    """``inputs`` settled by all retained claims, with ``claim``: settled, pending, ambiguous, or null where nobody claims.

    ``inputs``: origin, KEY, at_ms, kind, by_whom, evidence, controller, reasons; ``native``: origin and what the source
    itself told (native_by_whom, native_evidence, native_controller). A key settles if exactly one of its inputs is a
    submission up to the cutoff: claims and the source's word merge there, and a conflict stays. With none yet (pending)
    or several (ambiguous) no claim holds: what an earlier run settled is withdrawn to the source's word, but for a conflict
    of the claims among themselves.
    """
    said = claims.groupBy(*KEY).agg(F.min("by_whom").alias("_a"), F.max("by_whom").alias("_b"), F.min("controller").alias("_ca"), F.max("controller").alias("_cb"))
    sent = (F.col("kind") == "submission") & (F.col("at_ms") <= cutoff_ms)
    counted = inputs.filter(sent).groupBy(*KEY).agg(F.count_distinct("origin").alias("_n"))
    j = inputs.join(said, KEY, "left").join(counted, KEY, "left").join(native, "origin", "left")
    n = F.coalesce("_n", F.lit(0))
    told = F.col("native_evidence").isNotNull() & F.col("native_by_whom").isNotNull()
    undone = ~told & (F.col("evidence") == "provenance")
    plain = F.filter("reasons", lambda r: r != "input-origin-conflict")
    j = j.withColumns({
        "claim": F.when(F.col("_a").isNull(), None).when(n == 1, "settled").when(n == 0, "pending").otherwise("ambiguous"),
        "_own": F.struct(
            F.when(told, F.col("native_by_whom")).when(undone, "unknown").otherwise(F.col("by_whom")).alias("by_whom"), F.when(told, F.col("native_evidence")).when(undone, "none").otherwise(F.col("evidence")).alias("evidence"),
            F.when(told, F.col("native_controller")).when(~undone, F.col("controller")).alias("controller"), F.when(told | undone, plain).otherwise(F.col("reasons")).alias("reasons"),
        ),
    })
    sticky = F.col("_own.evidence") == "conflict"
    word = F.when(F.col("_own.by_whom") != "unknown", F.col("_own.by_whom"))
    clash = sticky | (F.least("_a", word) != F.greatest("_b", word))
    by = F.when(~sticky & (F.least("_ca", "_own.controller") == F.greatest("_cb", "_own.controller")), F.least("_ca", "_own.controller"))
    codes = F.array_sort(F.array_distinct(F.col("_own.reasons")))
    settled = F.struct(
        F.when(clash, "unknown").otherwise(F.col("_a")).alias("by_whom"), F.when(clash, "conflict").when(word.isNotNull() & (F.col("_own.evidence") == "source"), "source").otherwise("provenance").alias("evidence"),
        by.alias("controller"), F.when(clash, F.array_sort(F.array_distinct(F.concat(codes, F.array(F.lit("input-origin-conflict")))))).otherwise(codes).alias("reasons"),
    )
    own = F.struct(F.col("_own.by_whom").alias("by_whom"), F.col("_own.evidence").alias("evidence"), F.col("_own.controller").alias("controller"), codes.alias("reasons"))
    among = (F.col("evidence") == "conflict") & (F.col("_a") != F.col("_b"))
    withdrawn = ~among & ((F.col("evidence") == "provenance") | ((F.col("evidence") == "conflict") & F.col("native_evidence").isNotNull()))
    kept = F.struct("by_whom", "evidence", "controller", "reasons")
    now = F.when((F.col("claim") == "settled") & sent, settled).when(F.col("claim").isin("pending", "ambiguous") & withdrawn, own).otherwise(kept)
    j = j.withColumn("_now", now)
    return j.select(*[F.col(f"_now.{c}").alias(c) if c in ("by_whom", "evidence", "controller", "reasons") else F.col(c) for c in inputs.columns], "claim")


def matched(inputs: DataFrame, claims: DataFrame) -> DataFrame:
    """Inputs with origin, evidence and controller as claims and native evidence settle them.

    Claims of one origin settle an input; of several, or against the source's own evidence, they conflict and leave it
    unknown. A key that several inputs share is ambiguous and settles none.
    """
    said = claims.dropDuplicates([*KEY, "origin", "controller"]).groupBy(*KEY).agg(
        F.count_distinct("origin").alias("_n"), F.min("origin").alias("_origin"), F.when(F.count_distinct("controller") == 1, F.min("controller")).alias("_controller"))
    shared = inputs.filter(F.col("native_input").isNotNull()).groupBy(*KEY).agg((F.count("*") > 1).alias("_shared"))
    j = inputs.join(said, KEY, "left").join(shared, KEY, "left")
    own = F.col("native_origin")
    clash = (F.col("_n") > 1) | F.coalesce(own != F.col("_origin"), F.lit(False))
    state = F.when(F.col("_n").isNull(), F.when(own.isNotNull(), "source").otherwise("none")).when(F.col("_shared"), "ambiguous").when(clash, "conflict").otherwise("claim")
    origin = F.when(state == "claim", F.col("_origin")).when(state == "source", own).otherwise("unknown")
    return j.withColumns({"evidence": state, "origin_kind": origin, "controller": F.when(state == "claim", F.col("_controller"))}).drop("_n", "_origin", "_controller", "_shared")


def pending(inputs: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims whose input hasn't come yet."""
    return claims.join(inputs.select(*KEY).distinct(), KEY, "left_anti")
