"""Change capture and rollup invalidation over versions of a fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000


def dirty_days(old: DataFrame, new: DataFrame, key: str, at_ms: str, watched: list[str], end_ms: str | None = None) -> DataFrame:
    """UTC days, old and new, of rows that were added, removed or changed; * for rows without a time.

    With ``end_ms`` rows are intervals: the days of both ends, and * if they span more than one boundary of days.
    """
    times = [at_ms, *([end_ms] if end_ms else [])]
    cols = [*times, *watched]
    o = old.select(key, F.struct(*cols).alias("o"))
    n = new.select(key, F.struct(*cols).alias("n"))
    changed = o.join(n, key, "full_outer").filter(~F.col("o").eqNullSafe(F.col("n")))
    sides = changed.select(F.explode(F.filter(F.array("o", "n"), lambda x: x.isNotNull())).alias("x"))
    days = [F.coalesce(F.date_from_unix_date(F.expr(f"cast(x.{c} div {DAY} as int)")).cast("string"), F.lit("*")) for c in times]
    if end_ms:
        days.append(F.when(F.expr(f"x.{end_ms} div {DAY} - x.{at_ms} div {DAY} > 1"), "*"))
    return sides.select(F.explode(F.array_compact(F.array(*days))).alias("day")).distinct()


def invalidated(days: DataFrame, dirty: DataFrame) -> DataFrame:
    """Whether each local date's rollup must be built again: a dirty UTC day touches itself and its neighbours."""
    near = dirty.filter("day <> '*'").select(F.explode(F.array(*[F.date_add(F.to_date("day"), i).cast("string") for i in (-1, 0, 1)])).alias("date")).distinct().withColumn("hit", F.lit(True))
    every = dirty.agg(F.coalesce(F.max(F.col("day") == "*"), F.lit(False)).alias("every"))  # one row
    return days.join(near, "date", "left").crossJoin(F.broadcast(every)).select("date", (F.coalesce("hit", F.lit(False)) | F.col("every")).alias("stale"))
