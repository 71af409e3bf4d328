"""Half-open intervals in lanes: clipping, union, slot fan-out, subtraction, and the concurrency sweep.

Fan-out goes first, so every later window is bounded by one slot: a lane with very many intervals, or a busy day, is
spread over its hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock


def clip(intervals: DataFrame, start: Column, end: Column) -> DataFrame:
    """Intervals cut to [start, end); empty ones go."""
    return intervals.withColumns({"start_ms": F.greatest("start_ms", start), "end_ms": F.least("end_ms", end)}).filter("end_ms > start_ms")


def union(intervals: DataFrame, *lane: str) -> DataFrame:
    """Overlapping or touching intervals of a lane as one."""
    order = Window.partitionBy(*lane).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("start_ms") > reach).cast("int"), F.lit(1))
    marked = intervals.select(*lane, "start_ms", "end_ms", fresh.alias("fresh")).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*lane, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


def fan_out(intervals: DataFrame, zone: str) -> DataFrame:
    """A row for each elapsed hour of each local date that an interval meets, cut to it: adds date and slot."""
    d = intervals.withColumn("date", F.explode(F.sequence(clock.local_date("start_ms", zone), clock.local_date(F.col("end_ms") - 1, zone))))
    d = d.withColumns({"_from": clock.midnight("date", zone), "_to": clock.midnight(F.date_add("date", 1), zone)})
    first, last = F.greatest("start_ms", "_from"), F.least("end_ms", "_to")
    hour = lambda x: F.floor((x - F.col("_from")) / clock.HOUR).cast("int")
    d = d.filter(last > first).withColumn("slot", F.explode(F.sequence(hour(first), hour(last - 1))))
    begin = F.col("_from") + F.col("slot").cast("bigint") * clock.HOUR
    return clip(d, begin, F.least(begin + clock.HOUR, F.col("_to"))).drop("_from", "_to")


def levels(intervals: DataFrame, keys: list[str], lane: list[str]) -> DataFrame:
    """(keys, lanes, ms): for how long how many lanes ran at once within each key; idle time has no row."""
    one = union(intervals, *keys, *lane)
    steps = one.select(*keys, F.explode(F.array(F.struct(F.col("start_ms").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_ms").alias("t"), F.lit(-1).alias("d")))).alias("x")).select(*keys, "x.*")
    # A range frame gives all steps of one instant the level after them; only the last has time before the next.
    order = Window.partitionBy(*keys).orderBy("t")
    swept = steps.select(*keys, F.sum("d").over(order.rangeBetween(Window.unboundedPreceding, 0)).alias("lanes"), (F.lead("t").over(order) - F.col("t")).alias("ms"))
    return swept.filter("lanes > 0 and ms > 0").groupBy(*keys, "lanes").agg(F.sum("ms").alias("ms"))


def stats(intervals: DataFrame, keys: list[str], lane: list[str]) -> DataFrame:
    """active, agent and parallel milliseconds of each key, and its histogram as lanes:ms by lanes."""
    ms, lanes = F.col("ms"), F.col("lanes")
    return levels(intervals, keys, lane).groupBy(*keys).agg(
        F.sum("ms").alias("active_ms"), F.sum(ms * lanes).alias("agent_ms"), F.coalesce(F.sum(F.when(lanes > 1, ms)), F.lit(0)).alias("parallel_ms"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lanes", "ms"))), lambda x: F.concat_ws(":", x["lanes"], x["ms"])), ",").alias("histogram"),
    )


def in_windows(windows: DataFrame, intervals: DataFrame, keys: list[str], lane: list[str], elapsed: Column, known_empty: Column) -> DataFrame:
    """``windows`` with the work in each: stats(), inference_ms, and a histogram whose idle bin 0 makes it add up to ``elapsed``.

    A window without a lane has null numbers and is unavailable, or zeros if it is known to be empty. ``intervals`` are cut to the windows.
    """
    inference = levels(intervals.filter("kind = 'inference'"), keys, lane).groupBy(*keys).agg(F.sum("ms").alias("inference_ms"))
    told = stats(intervals, keys, lane).join(inference, keys, "left").withColumn("inference_ms", F.coalesce("inference_ms", F.lit(0)))
    out = windows.join(told, keys, "left")
    there = F.col("active_ms").isNotNull()
    idle = elapsed - F.coalesce("active_ms", F.lit(0))
    bins = F.array_compact(F.array(F.when((there | known_empty) & (idle > 0), F.concat(F.lit("0:"), idle.cast("string"))), F.col("histogram")))
    numbers = {c: F.when(there, F.col(c)).when(known_empty, F.lit(0)) for c in ("active_ms", "inference_ms", "agent_ms", "parallel_ms")}
    return out.withColumns({"histogram": F.when(there | known_empty, F.array_join(bins, ",")), "status": F.when(there | known_empty, "recorded").otherwise("unavailable"), **numbers})


def subtract(work: DataFrame, waits: DataFrame, *lane: str) -> DataFrame:
    """What of each lane's united work no wait of the lane covers."""
    w = union(work, *lane).withColumn("d", F.lit(1)).unionByName(union(waits, *lane).withColumn("d", F.lit(-1)))
    plus, minus = (F.when(F.col("d") == s, 1).otherwise(0) for s in (1, -1))
    steps = w.select(*lane, F.col("start_ms").alias("t"), plus.alias("work"), minus.alias("wait")).unionByName(w.select(*lane, F.col("end_ms").alias("t"), (-plus).alias("work"), (-minus).alias("wait")))
    steps = steps.groupBy(*lane, "t").agg(F.sum("work").alias("work"), F.sum("wait").alias("wait"))
    order = Window.partitionBy(*lane).orderBy("t")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    cut = steps.select(*lane, F.col("t").alias("start_ms"), F.lead("t").over(order).alias("end_ms"), F.sum("work").over(run).alias("on"), F.sum("wait").over(run).alias("off"))
    return union(cut.filter("on > 0 and off = 0 and end_ms > start_ms"), *lane)
