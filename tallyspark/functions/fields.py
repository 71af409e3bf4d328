"""Scalar fields of native records: instants, labels, item types, ids, ratios, completeness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quality import REASONS

#: Native item types by what they are.
INFERENCE, TOOLS = ("agentmessage", "reasoning", "plan"), ("commandexecution", "mcptoolcall", "filechange", "websearch", "imageview")
#: Codes that say nothing about tokens, and nothing about work.
TIMING = ("timing-unavailable", "open-interval", "stale-ref")
ACCOUNTING = ("unknown-model", "unallocated-history", "counter-discontinuity", "duplicate-ambiguity", "upstream-owned", "stale-ref")


def instant(text: Column, ms: Column) -> Column:
    """Epoch milliseconds from ISO text or a nonnegative number; else null."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(text)), F.when(ms >= 0, ms))


def labelled(x: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit("unknown"))


def item_type(x: Column) -> Column:
    """inference, tool or excluded, whatever the case and separators of the native name."""
    plain = F.lower(F.regexp_replace(x, "[^A-Za-z0-9]", ""))
    return F.when(plain.isin(*INFERENCE), "inference").when(plain.isin(*TOOLS), "tool").otherwise("excluded")


def joined_id(*parts: Column) -> Column:
    """An id of several parts; each carries its length, so no two lists of parts give one text."""
    text = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat(*[F.concat(F.length(t).cast("string"), F.lit(":"), t, F.lit(";")) for t in text]), 256)


def share(a: Column, b: Column) -> Column:
    """a / b to six places; null where b is zero or either is unknown."""
    return F.round(F.try_divide(a * F.lit(1.0), b), 6)


def relevant(codes: Column, without: tuple[str, ...]) -> Column:
    return F.array_sort(F.array_except(F.array_intersect(codes, F.array(*map(F.lit, REASONS))), F.array(*map(F.lit, without))))
