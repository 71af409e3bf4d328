"""Null-aware metrics with a status, quality algebra and reason codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CEILING = 2**53 - 1
#: The public reason codes.
REASONS = (
    "missing-source", "unsupported-schema", "parse-gap", "unknown-model", "unpriced-model", "incomplete-token-breakdown",
    "unallocated-history", "counter-discontinuity", "duplicate-ambiguity", "upstream-owned", "timing-unavailable", "open-interval",
    "unattributed-session", "stale-ref", "input-history-incomplete", "input-kind-unknown", "input-origin-conflict", "input-origin-unknown",
)


def known_sum(x: Column | str, name: str, quality: Column | str = "quality", evidence: Column | None = None) -> list[Column]:
    """``name`` and ``name_status``: the sum of known values, null if none is known or it leaves the exact range.

    A whole sum has the quality of the source's evidence (recorded, if not given), partial where the records' differs; any
    other sum is partial.
    """
    x = F.col(x) if isinstance(x, str) else x
    total = F.sum(x)
    whole = (F.count(x) == F.count("*")) & (total <= CEILING)
    status = degraded(F.lit("recorded") if evidence is None else F.first(evidence), combined(quality))
    return [F.when(total <= CEILING, total).alias(name), F.when(F.count(x) == 0, "unavailable").when(whole, status).otherwise("partial").alias(f"{name}_status")]


def known_empty(value: Column, status: Column, empty: Column, evidence: Column) -> tuple[Column, Column]:
    """Value and status of a group without records: 0 as the evidence has it where nothing is known to be missing."""
    return F.when(value.isNull() & status.isNull() & empty, F.lit(0)).otherwise(value), F.coalesce(status, F.when(empty, evidence).otherwise("unavailable"))


def combined(quality: Column | str) -> Column:
    """The quality of a group: all recorded, none available, or partial."""
    q = F.col(quality) if isinstance(quality, str) else quality
    n, good, none = F.count("*"), F.count_if(q == "recorded"), F.count_if(q == "unavailable")
    return F.when(none == n, "unavailable").when(good == n, "recorded").otherwise("partial")


def degraded(a: Column, b: Column) -> Column:
    return F.when(a == b, a).otherwise("partial")


def reasons(codes: Column) -> Column:
    """Allowed codes, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.array_intersect(codes, F.array(*map(F.lit, REASONS)))))


def all_reasons(codes: str) -> Column:
    """The union of a group's codes; partial sets meet before the shuffle."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(codes))))


def public_label(x: Column) -> Column:
    """A label safe to show: 1 to 128 letters, digits and ._-/:+()[], no address, no secret's prefix; else ``unknown``."""
    plain = x.rlike(r"^[A-Za-z0-9._\-/:+()\[\]]{1,128}\z") & ~F.contains(x, F.lit("://"))
    secret = F.lower(x).rlike(r"^(sk-|ghp_|gho_|ghs_|github_pat_)")
    return F.when(plain & ~secret, x).otherwise("unknown")
