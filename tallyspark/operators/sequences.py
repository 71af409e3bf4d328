"""Ordered state: counter deltas, checkpoint segments, forward fill, streaks, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counter_deltas(readings: DataFrame, key: str, *order: str) -> DataFrame:
    """Increases between readings of a cumulative counter; a fall is a reset: it bills nothing and starts an epoch."""
    w = Window.partitionBy(key).orderBy(*order)
    d = readings.withColumn("before", F.lag("reading").over(w))
    d = d.withColumn("reset", F.coalesce((F.col("reading") < F.col("before")).cast("int"), F.lit(0)))
    d = d.withColumn("epoch", F.sum("reset").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("delta", F.when(F.col("before").isNull(), F.col("reading")).when(F.col("reset") == 1, 0).otherwise(F.col("reading") - F.col("before"))).drop("before")


def segment_sums(rows: DataFrame, key: str, checkpoint: str, value: str, *order: str) -> DataFrame:
    """Sums between checkpoints; one unknown value makes its segment unknown."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    s = rows.withColumn("segment", F.sum(F.col(checkpoint).cast("int")).over(w))
    return s.groupBy(key, "segment").agg(F.when(F.count(value) == F.count("*"), F.sum(value)).alias("value"), F.count("*").alias("records"))


def filled(rows: DataFrame, key: str, context: str, *order: str) -> DataFrame:
    """Each row with the last context before or at it, as a whole struct: a null inside a newer context stays null."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(context, F.last(context, ignorenulls=True).over(w))


def longest_run(rows: DataFrame, key: list[str], position: str) -> DataFrame:
    """The longest run of consecutive positions of each key."""
    w = Window.partitionBy(*key).orderBy(position)
    runs = rows.select(*key, (F.col(position) - F.row_number().over(w)).alias("run"))
    return runs.groupBy(*key, "run").agg(F.count("*").alias("n")).groupBy(*key).agg(F.max("n").alias("longest"))


def roots(nodes: DataFrame) -> DataFrame:
    """(id, root, depth) by pointer doubling: each round doubles the reach, so rounds are the log of the depth.

    A node without a known parent is its own root; members of a cycle get a null root.
    """
    have = nodes.select(F.col("id").alias("_p"))
    at = nodes.join(have, nodes.parent == F.col("_p"), "left").select("id", F.coalesce("_p", "id").alias("up"), F.col("_p").isNotNull().cast("bigint").alias("depth")).checkpoint()
    n = nodes.count()
    reach = 1
    while reach < 2 * max(1, n):
        hop = at.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        step = at.join(hop, "up").select("id", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("up") != F.col("up2")).alias("moved")).checkpoint()
        at, reach = step.drop("moved"), reach * 2
        if step.filter("moved").isEmpty():
            break
    ends = nodes.join(have, nodes.parent == F.col("_p"), "left_anti").select(F.col("id").alias("up"), F.lit(True).alias("ends"))
    return at.join(ends, "up", "left").select("id", F.when(F.col("ends"), F.col("up")).alias("root"), F.when(F.col("ends"), F.col("depth")).alias("depth"))
