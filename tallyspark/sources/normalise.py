"""Token usage of five kinds of source as disjoint buckets: uncached, cache_read, cache_write, output, reasoning, total.

Each function takes columns (null: not given; numbers only, as typed projections give them) and returns a struct with
quality and reasons. A count outside 0 .. 2^53 - 1 is unknown, never zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.quality import CEILING

GAP = "parse-gap"


def count(x: Column) -> Column:
    return F.when(x.between(0, CEILING), x.cast("long"))


def micro(dollars: Column) -> Column:
    """Dollars as micro-USD, halves up; zero, negative or absent money is unknown."""
    return F.when(dollars > 0, F.floor(dollars * 1_000_000 + 0.5).cast("long"))


def cost_kind(status: Column, estimated: Column, actual: Column) -> Column:
    s = F.lower(status)
    return F.when((s == "actual") & actual.isNotNull(), "provider-reported").when((s == "estimated") & estimated.isNotNull(), "source-estimate").when(s == "included", "included").otherwise("unknown")


def _made(uncached, read, write, output, reasoning, total, gap) -> Column:
    whole = uncached.isNotNull() & read.isNotNull() & write.isNotNull() & output.isNotNull() & total.isNotNull() & ~gap
    return F.struct(
        uncached.alias("uncached"), read.alias("cache_read"), write.alias("cache_write"), output.alias("output"), reasoning.alias("reasoning"), total.alias("total"),
        F.when(whole, "recorded").otherwise("partial").alias("quality"), F.when(whole, F.array().cast("array<string>")).otherwise(F.array(F.lit(GAP))).alias("reasons"),
    )


def _within(reasoning: Column, output: Column) -> tuple[Column, Column]:
    bad = F.coalesce(reasoning > output, F.lit(False))
    return F.when(~bad, reasoning), bad


def inclusive_input(input_: Column, read: Column, write: Column, output: Column, reasoning: Column, total: Column) -> Column:
    """Input counts hold the cached ones: what is left is uncached, if it isn't negative and all add up to the total."""
    i, r, w, o, t = count(input_), count(read), F.coalesce(count(write), F.lit(0)), count(output), count(total)
    rest = i - r - w
    sound = F.coalesce((rest >= 0) & (i + o == t), F.lit(False))
    reason, bad = _within(count(reasoning), o)
    return _made(F.when(sound, rest), r, w, o, reason, t, ~sound | bad)


def disjoint(input_: Column, read: Column, write: Column, output: Column, reasoning: Column) -> Column:
    """Buckets are given apart; the total is theirs, if all are known."""
    i, r, w, o = map(count, (input_, read, write, output))
    reason, bad = _within(count(reasoning), o)
    return _made(i, r, w, o, reason, i + r + w + o, bad)


def with_residual(input_: Column, read: Column, write: Column, output: Column, reasoning: Column, total: Column) -> Column:
    """A reported total stays if it is no less than the buckets; else it is derived."""
    i, r, w, o, t = map(count, (input_, read, write, output, total))
    known = i + r + w + o
    reason, bad = _within(count(reasoning), o)
    short = F.coalesce(t < known, F.lit(False))
    return _made(i, r, w, o, reason, F.when(t.isNull() | short, known).otherwise(t), bad | short)


def reasoning_resolved(input_: Column, read: Column, write: Column, output: Column, reasoning: Column, total: Column) -> Column:
    """Whether reasoning is within the output or beside it: whichever sum is the total."""
    i, r, w, o, q, t = map(count, (input_, read, write, output, reasoning, total))
    base = i + r + w + o
    beside, within = F.coalesce(base + q == t, F.lit(False)), F.coalesce((base == t) & (F.coalesce(q, F.lit(0)) <= o), F.lit(False))
    inside = within | t.isNull()
    out = F.when(inside, o).when(beside, o + q).otherwise(o)
    reason, bad = _within(q, out)
    return _made(i, r, w, out, reason, F.coalesce(t, base), bad | ~(inside | beside))


def cumulative(input_: Column, read: Column, write: Column, output: Column, reasoning: Column) -> Column:
    i, r, w, o, q = map(count, (input_, read, write, output, reasoning))
    return _made(i, r, w, o, q, i + r + w + o, F.lit(False))
