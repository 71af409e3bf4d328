"""Scope of a session: a ladder of evidence, inheritance from parents, and exactly one row for each usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(path: Column, root: Column) -> Column:
    """Whether a path is a root or below it, by whole components."""
    return (path == root) | F.startswith(path, F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))


def decided(facts: DataFrame) -> DataFrame:
    """Adds decision and scope_reason to (identities, live_included, live_known, in_root, historical, cached, path).

    ``identities`` counts distinct live repositories; the others are booleans that the driver resolved once for each
    distinct workspace; ``path`` is the workspace or null. The first step that holds decides.
    """
    ladder = (
        (F.col("identities") > 1, "unattributed", "attribution-conflict"), (F.col("live_included"), "included", "repository-identity"), (F.col("live_known"), "out-of-scope", "unrelated-live-repository"),
        (F.col("in_root"), "included", "configured-root"), (F.col("historical"), "included", "historical-attribution"), (F.col("cached"), "included", "cached-attribution"), (F.col("path").isNull(), "unattributed", "attribution-unavailable"),
    )
    decision, reason = F.lit("out-of-scope"), F.lit("outside-configured-scope")
    for holds, d, r in reversed(ladder):
        holds = F.coalesce(holds, F.lit(False))
        decision, reason = F.when(holds, d).otherwise(decision), F.when(holds, r).otherwise(reason)
    return facts.withColumns({"decision": decision, "scope_reason": reason})


def inherited(sessions: DataFrame, roots: DataFrame) -> DataFrame:
    """Sessions without a path of their own take their root's decision; in a cycle (null root) they conflict."""
    top = sessions.select(F.col("id").alias("root"), F.col("decision").alias("_d"), F.col("scope_reason").alias("_r"))
    j = sessions.join(roots.select("id", "root"), "id").join(top, "root", "left")
    bare = F.col("path").isNull()
    return j.select(
        *[c for c in sessions.columns if c not in ("decision", "scope_reason")],
        F.when(bare & F.col("root").isNull(), "unattributed").when(bare, F.col("_d")).otherwise(F.col("decision")).alias("decision"),
        F.when(bare & F.col("root").isNull(), "attribution-conflict").when(bare, F.col("_r")).otherwise(F.col("scope_reason")).alias("scope_reason"),
    )
