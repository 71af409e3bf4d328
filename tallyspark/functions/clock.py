"""Local calendar in a time zone: dates, midnights, day spines and elapsed-hour slots (23 or 25 on DST days)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000


def local_date(ms: Column | str, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(ms), zone))


def midnight(date: Column | str, zone: str) -> Column:
    """The instant of local midnight. The session's zone must be UTC."""
    return F.unix_millis(F.to_utc_timestamp(F.col(date).cast("timestamp") if isinstance(date, str) else date.cast("timestamp"), zone))


def spine(spark: SparkSession, cutoff_ms: int, zone: str, days: int) -> DataFrame:
    """(date, start_ms, end_ms) of the last ``days`` local dates up to the cutoff's; the last ends at the cutoff."""
    last = local_date(F.lit(cutoff_ms), zone)
    d = spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("date"))
    return d.select("date", midnight("date", zone).alias("start_ms"), F.least(midnight(F.date_add("date", 1), zone), F.lit(cutoff_ms)).alias("end_ms"))


def slots(days: DataFrame) -> DataFrame:
    """(date, slot, slot_start, slot_end): elapsed hours from local midnight, the last one cut off with its day."""
    some = days.filter("end_ms > start_ms").select("date", "end_ms", F.posexplode(F.sequence(F.col("start_ms"), F.col("end_ms") - 1, F.lit(HOUR))).alias("slot", "slot_start"))
    return some.select("date", "slot", "slot_start", F.least(F.col("slot_start") + HOUR, "end_ms").alias("slot_end"))
