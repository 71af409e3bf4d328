"""The public snapshot: one nested document a day, checked, then written with its index last."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAYS = 400


def days(spine: DataFrame, usage_days: DataFrame, work_slots: DataFrame, usage_rows: DataFrame) -> DataFrame:
    """(date, usage, work slots, usage rows) nested; a day's slots and rows are bounded by its hours and its labels."""
    nest = lambda df, name, *order: df.groupBy("date").agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c != "date" and c not in order]))).alias(name))
    out = spine.select("date").join(usage_days.select("date", F.struct(*[c for c in usage_days.columns if c != "date"]).alias("usage")), "date", "left")
    return out.join(nest(work_slots, "hours", "slot"), "date", "left").join(nest(usage_rows, "usage_rows", "agent", "provider", "model"), "date", "left")


def violations(work_slots: DataFrame) -> DataFrame:
    """Slots whose numbers contradict each other: a part above its whole, or a histogram that isn't its sum. The idle bin 0 counts for neither."""
    parts = F.filter(F.transform(F.split("histogram", ","), lambda p: F.struct(F.split_part(p, F.lit(":"), F.lit(1)).cast("long").alias("n"), F.split_part(p, F.lit(":"), F.lit(2)).cast("long").alias("ms"))), lambda x: x["n"] > 0)
    total = lambda f: F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + f(x))
    bad = (F.col("parallel_ms") > F.col("active_ms")) | (F.col("active_ms") > F.col("agent_ms")) | (total(lambda x: x["ms"]) != F.col("active_ms")) | (total(lambda x: x["ms"] * x["n"]) != F.col("agent_ms"))
    return work_slots.filter(F.col("histogram").isNotNull() & bad)


def export(document: DataFrame, folder: str, private: list[str]) -> None:
    """Writes one JSON line a day, unless a private string shows or there are over ``DAYS``; the index is renamed last."""
    os.makedirs(folder, exist_ok=True)
    lines = [r[0] for r in document.orderBy("date").limit(DAYS + 1).select(F.to_json(F.struct(*document.columns))).collect()]
    if len(lines) > DAYS:
        raise ValueError(f"a snapshot has {DAYS} days at most")
    told = [p for p in private if p and any(p in x for x in lines)]
    if told:
        raise ValueError(f"{len(told)} private strings would be public")
    temp = f"{folder}/.{uuid.uuid4()}"
    with open(temp, "w") as f:
        json.dump({"days": [json.loads(x) for x in lines]}, f)
    os.replace(temp, f"{folder}/activity.json")
