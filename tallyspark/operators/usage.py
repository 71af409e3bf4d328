"""Aggregates of token usage, cost and scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pricing
from ..functions.quality import CEILING, known_sum

COUNTERS = ("total", "uncached", "cache_read", "cache_write", "output", "reasoning")


def sums(usage: DataFrame, *keys: str) -> DataFrame:
    return usage.groupBy(*keys).agg(F.count("*").alias("records"), *[c for name in COUNTERS for c in known_sum(name, name)])


def _residual() -> Column:
    """What a complete row's total holds beyond its buckets; null if incomplete or negative."""
    rest = F.col("total") - sum((F.col(b) for b in pricing.BUCKETS[1:]), F.col(pricing.BUCKETS[0]))
    return F.when(rest >= 0, rest)


def residual(usage: DataFrame, *keys: str) -> DataFrame:
    return usage.groupBy(*keys).agg(*known_sum(_residual(), "other"))


def cache_basis(usage: DataFrame, *keys: str) -> DataFrame:
    """Reads and prompts over rows that know all three prompt buckets; null without prompts."""
    prompt = F.col("uncached") + F.col("cache_read") + F.col("cache_write")
    s = usage.groupBy(*keys).agg(F.sum(F.when(prompt.isNotNull(), F.col("cache_read"))).alias("read"), F.sum(prompt).alias("prompt"), F.count(prompt).alias("paired"), F.count("*").alias("records"))
    some = F.col("prompt") > 0
    return s.select(*keys, F.when(some, F.col("read")).alias("cache_read"), F.when(some, F.col("prompt")).alias("prompt"), F.when(~F.coalesce(some, F.lit(False)), "unavailable").when(F.col("paired") == F.col("records"), "recorded").otherwise("partial").alias("status"), F.round(F.try_divide(F.col("read") * 1.0, F.col("prompt")), 6).alias("share"))


def priced_cost(usage: DataFrame, *keys: str) -> DataFrame:
    """Priced and unpriced records and tokens, and the priced subset's exact value."""
    p, ok = pricing.priced(usage), F.col("why_unpriced").isNull()
    tokens = F.coalesce("total", F.lit(0))
    total = F.sum(F.col("nano_usd").cast("decimal(38,0)"))
    return p.groupBy(*keys).agg(
        F.count_if(ok).alias("priced_records"), F.count_if(~ok).alias("unpriced_records"), F.coalesce(F.sum(F.when(ok, tokens)), F.lit(0)).alias("priced_tokens"), F.coalesce(F.sum(F.when(~ok, tokens)), F.lit(0)).alias("unpriced_tokens"),
        F.when(total <= CEILING, total.cast("bigint")).alias("nano_usd"), F.array_join(F.array_sort(F.collect_set("why_unpriced")), ",").alias("reasons"),
    )


def source_cost(usage: DataFrame, *keys: str) -> DataFrame:
    """What sources themselves reported, by kind; partial if any row's cost is unknown."""
    of = lambda kind: F.sum(F.when(F.col("cost_kind") == kind, F.col("cost_micro")))
    return usage.groupBy(*keys).agg(of("provider-reported").alias("reported_micro"), of("source-estimate").alias("estimated_micro"), F.count_if(F.col("cost_kind") == "included").alias("included_records"), F.when(F.count_if(F.col("cost_kind") == "unknown") > 0, "partial").otherwise("recorded").alias("status"))


def scope_coverage(evidence: DataFrame, *keys: str) -> DataFrame:
    return evidence.groupBy(*keys, "decision").agg(F.count("*").alias("records"), F.sum(F.coalesce("total", F.lit(0))).alias("known_tokens"), F.count_if(F.col("total").isNull()).alias("unknown_total"))


def scope_report(evidence: DataFrame) -> DataFrame:
    """Totals by decision and by five keys, in one pass of grouping sets."""
    evidence.createOrReplaceTempView("_scope_evidence")
    return evidence.sparkSession.sql("""
      SELECT decision, agent, provider, model, quality, grouping(agent) AS is_total, count(*) AS records, sum(coalesce(total, 0)) AS known_tokens, count_if(total IS NULL) AS unknown_total
      FROM _scope_evidence GROUP BY GROUPING SETS ((decision), (decision, agent, provider, model, quality))""")


def anti_union(usage: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence, and usage that no evidence row accounts for."""
    return evidence.unionByName(usage.join(evidence.select("origin"), "origin", "left_anti"))


def series(usage: DataFrame, key: str) -> DataFrame:
    """Tokens by day and key, of keys with any, ranked by total, then name. A null row makes its key's day null."""
    day = usage.groupBy("date", F.col(key).alias("key")).agg(F.when(F.count("total") == F.count("*"), F.sum("total")).alias("tokens"), F.sum(F.coalesce("total", F.lit(0))).alias("known"))
    rank = day.groupBy("key").agg(F.sum("known").alias("key_total")).filter("key_total > 0")
    return day.join(rank, "key").select("date", "key", "tokens", "key_total")
